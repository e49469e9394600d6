import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from llm_cases import EDGE, documents, fetch, rows_of, table

from ledgerlens.llm import lang_id
from ledgerlens.llm.queries import op8_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op8_language_id(spark, sf).collect()}
    rows = fetch("documents", "doc_id, lang, text", sf)
    assert len(got) == len(rows)
    right = []
    for doc_id, lang, text in rows:
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.held_out and any(c.isalpha() for c in text):
            right.append(r.lang_pred == lang)
    assert len(right) > 150 and np.mean(right) >= 0.97


def test_bundle_is_the_sum_of_bound_vectors():
    """Brute force: permute and multiply the letter vectors of every trigram, one by one."""
    text = "Ça va, été?"
    signs = {c: lang_id._signs(lang_id._letter_bits(np.array([0 if c == "_" else ord(c)])))[0] for c in set(text.lower()) | {"_"} if c == "_" or c.isalpha()}
    roll = lambda v, k: np.roll(v.reshape(lang_id.WORDS, 64), k, axis=0).ravel()
    want = np.zeros(lang_id.DIM)
    for word in ["ça", "va", "été"]:
        w = f"_{word}_"
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            want += roll(signs[a], 2) * roll(signs[b], 1) * signs[c]
    spelled, which, own = lang_id.trigrams(["", text, "?"])
    assert set(own.tolist()) == {1}
    assert (lang_id.bound(spelled)[which].sum(axis=0) == want).all()
    assert (lang_id.bundles(spelled, which, own, 3) == [0 * want, want, 0 * want]).all()


@pytest.mark.parametrize("limits", [(1, 1), (7, 20), (4096, 1 << 21)])
def test_bundles_in_slices(monkeypatch, limits):
    """Any number of trigrams and groups at a time gives the sums of all vectors, group by group."""
    monkeypatch.setattr(lang_id, "SLICE", limits[0])
    monkeypatch.setattr(lang_id, "CELLS", limits[1])
    texts = ["the cat and the hat", "", "été là-bas", "the the the", "x"]
    spelled, which, own = lang_id.trigrams(texts)
    group = np.array([2, 0, 1, 2, 1])[own]
    want = np.zeros((4, lang_id.DIM))
    np.add.at(want, group, lang_id.bound(spelled)[which])
    assert (lang_id.bundles(spelled, which, group, 4) == want).all()


def test_memory_of_a_long_text_of_many_letters_and_of_many_labels():
    """6 MB of varied CJK letters in one text, and 500 labels, in a process of its own."""
    code = (
        "import resource\n"
        "import numpy as np\n"
        "from ledgerlens.llm import lang_id\n"
        "r = np.random.default_rng(1)\n"
        "text = ''.join(map(chr, r.integers(0x4E00, 0x9FA5, 2_000_000)))\n"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "model = lang_id.Model(tuple(f'l{i:03d}' for i in range(500)), r.normal(size=(500, lang_id.DIM)))\n"
        "best, score = model.score([text, 'abc'])\n"
        "assert 0 <= score[0] <= 1 and best[0] in model.languages\n"
        "spelled, which, own = lang_id.trigrams([text[i * 300 : i * 300 + 300] for i in range(500)])\n"
        "assert lang_id.bundles(spelled, which, own, 500).shape == (500, lang_id.DIM)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)\n"
    )
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=False)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) < 700, "MB over the start"


def test_edge_rows(spark):
    model = lang_id.train(table(spark, "documents"))
    got = {(r.doc_id, r.text): r for r in lang_id.identify(documents(spark, EDGE), model).collect()}
    for doc_id, text in EDGE:
        r = got[doc_id, text]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages
    assert lang_id.identify(documents(spark, EDGE), model).count() == len(EDGE)


def test_prediction_sees_the_text_alone(spark):
    model = lang_id.train(table(spark, "documents"))
    a = lang_id.identify(documents(spark, [(1, "the of and"), (2, "que les des")]), model)
    b = lang_id.identify(documents(spark, [(7, "the of and", "xx"), (9, "que les des", None)]), model)
    pick = lambda df: sorted((r.text, r.lang_pred, r.score) for r in df.collect())
    assert pick(a) == pick(b)


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in lang_id.predict(documents(spark, [(1, "abc", None), (None, "abc", "en")])).collect()] == ["und", "und"]
    assert lang_id.predict(documents(spark, [])).collect() == []


def test_clashing_columns(spark):
    docs = table(spark, "documents").withColumnRenamed("source", "score").withColumnRenamed("n_chars", "lang_pred")
    out = lang_id.identify(docs, lang_id.train(docs))
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "lang_pred", "score"]
    assert rows_of(lang_id.predict(docs)) == rows_of(op8_language_id(spark, "/root/testdata/sf0.001"))
