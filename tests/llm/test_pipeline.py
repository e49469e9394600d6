import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from llm_cases import DOCUMENT, EDGE, SF, documents, fetch, rows_of, sentence, table
from test_decontam import brute as contaminated
from test_neardup import brute as near
from test_substring import brute as repeats
from tokenizers import Tokenizer

from ledgerlens.llm import storage


def expected(rows, items):
    """The stages by brute force (language ID: letters or none, which is what it rejects by)."""
    rows = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    rows = sorted(rows)
    low = {d: c for d, _, c in near(rows)}
    rows = [r for r in rows if low[r[0]] == r[0]]
    rows = [(d, kept) for d, _, _, _, kept in repeats(rows)]
    bad = {r[0] for r in contaminated(rows, items) if r[-1]}
    rows = [r for r in rows if r[0] not in bad]
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_whole_run(spark):
    rows, items = fetch("documents", "doc_id, text"), fetch("benchmark", "item_id, text")
    got = corpus_pipeline.run(spark, SF)
    assert rows_of(got) == expected(rows, items)
    assert 0 < got.count() < len(rows)


def stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, storage.cut(spark, stage(spark, docs, SF), name)
        yield name, before, docs


def test_stages_keep_the_columns_and_act(spark):
    for name, before, after in stages(spark, table(spark, "documents")):
        assert after.count() <= before.count()
        if name != "bpe_encoding":
            assert after.columns == table(spark, "documents").columns and after.schema.simpleString() == before.schema.simpleString()
        if name == "substring_dedup":
            assert after.count() == before.count()
            assert before.join(after, "doc_id").where(before["text"] != after["text"]).count() > 0
            assert after.where("n_chars <> char_length(text)").count() == 0
        elif name in ("ngram_join", "decontamination"):
            assert after.count() < before.count()


def test_language_id_keeps_texts_with_letters_whatever_was_learned(spark):
    texts = ["a clean text", "日本語", "Ünï 1", "12 34 -- 5", "", None]
    for rows in (
        [(i, t, None) for i, t in enumerate(texts)],  # no labels
        [(None, t, "en") for t in texts],  # nothing to learn from without an id
        [(i, t, "und") for i, t in enumerate(texts)],  # a label that reads like the unknown one
    ):
        got = corpus_pipeline.language_id(spark, documents(spark, rows), SF)
        assert sorted(r.text for r in got.collect()) == sorted(texts[:3])


def test_planted_cases(spark):
    (item,) = fetch("benchmark", "text")[0]
    base = fetch("documents", "doc_id, text, lang")[:40]
    passage = sentence(77, 60)
    rows = base + [
        (9001, base[0][1], "en"),  # an exact copy
        (9002, sentence(1, 200), "en"),
        (9003, sentence(1, 200) + " end", "en"),  # a near copy
        (9004, sentence(2, 80) + " " + passage, "en"),
        (9005, sentence(3, 80) + " " + passage, "en"),  # a repeated passage
        (9006, sentence(4, 80) + " " + item, "en"),  # a benchmark passage
        (9007, "12 34 ... 56", "en"),
        (9008, None, "en"),
    ]
    steps = {name: {r.doc_id: r for r in after.collect()} for name, _, after in stages(spark, documents(spark, rows))}
    assert 9007 not in steps["language_id"] and 9008 not in steps["language_id"] and 9006 in steps["language_id"]
    assert 9001 not in steps["ngram_join"] and 9003 not in steps["ngram_join"] and 9002 in steps["ngram_join"]
    assert steps["substring_dedup"][9004].text.endswith(passage)
    assert steps["substring_dedup"][9005].text == " ".join(sentence(3, 80).split())
    assert 9006 not in steps["decontamination"]
    assert {9002, 9004, 9005} <= set(steps["bpe_encoding"])


def test_edge_rows_pass_through(spark):
    for name, _, after in stages(spark, documents(spark, EDGE)):
        ids = [r.doc_id for r in after.collect()]
        if name == "language_id":
            assert ids.count(5) == 2 and 1 not in ids and 3 not in ids
        if name == "ngram_join":
            # the null id counts as the smallest and stands for 7, 8 and itself
            assert sorted(i for i in ids if i is not None) == [4, 5, 6, 9, 10, 11, 12, 12] and ids.count(None) == 1


def test_empty_table_and_more_columns(spark):
    for _, _, after in stages(spark, documents(spark, [])):
        assert after.collect() == []
    more = documents(spark, EDGE).selectExpr("*", "1 AS tk", "2 AS id", "3 AS lang_pred")
    for name, _, after in stages(spark, more):
        if name != "bpe_encoding":
            assert after.columns == [*DOCUMENT.names, "tk", "id", "lang_pred"]
