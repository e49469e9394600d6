import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGE, documents, fetch, rows_of
from tokenizers import Tokenizer

from ledgerlens.llm import bpe
from ledgerlens.llm.queries import QUERIES, op7_bpe
from ledgerlens.llm.shipping import ship

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows(spark, library):
    ship(spark)
    got = bpe.token_digests(documents(spark, EDGE), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows_of(got) == expected(library, EDGE)


def test_whole_table(spark, library):
    got = op7_bpe(spark, "/root/testdata/sf0.001")
    assert rows_of(got) == expected(library, fetch("documents", "doc_id, text"))


def test_empty_table_and_clashing_columns(spark):
    docs = documents(spark, EDGE).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "ids")
    assert bpe.token_digests(docs, PATH).count() == len(EDGE)
    assert bpe.token_digests(documents(spark, []), PATH).collect() == []
    assert bpe.encode_documents(documents(spark, []), PATH).collect() == []


def test_general_form_round_trip(spark, library):
    for r in bpe.encode_documents(documents(spark, EDGE), PATH).join(documents(spark, EDGE).distinct(), "doc_id").collect():
        if r.doc_id in (4, 6, 7):
            assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text


def test_random_texts(library):
    r, enc = random.Random(5), bpe.Encoder(PATH)
    letters = "ab \n\té１2'st<|>?!“日😀́ 　\x1c\x85​"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    ids, n = enc.encode(texts)
    ends = np.cumsum(n)
    for text, end, k in zip(texts, ends, n, strict=True):
        assert ids[end - k : end].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_verification_rejects_wrong_proposals(library):
    """Greedy proposals alone are wrong for many words; the pair check finds exactly those."""
    tool = bpe.Bpe(PATH)
    words = sorted({w for (t,) in fetch("documents", "text") for w in t.split()})[:20_000]
    proposed = [tool.greedy(w.encode()) for w in words]
    exact = [tool.merged(w.encode()) for w in words]
    found, merged = tool.encode_words([w.encode() for w in words])
    assert found == exact
    assert 0 < sum(a != b for a, b in zip(proposed, exact, strict=True)) <= merged < len(words)


def test_small_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 10)
    enc = bpe.Encoder(PATH)
    for t in ["a b c d e f g h i j k l m", "n o p", "a b c"]:
        assert enc.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_registered():
    assert "op7_bpe" in QUERIES
