import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_cases import EDGE, documents, fetch, rows_of
from tokenizers import Tokenizer

from ledgerlens.llm import token_store as ts
from ledgerlens.llm.queries import op10_token_files
from ledgerlens.llm.storage import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    return sorted(out, key=repr)


def test_whole_table(spark):
    got = op10_token_files(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert rows_of(got) == expected(sorted(fetch("documents", "doc_id, text")))


def test_edge_rows_many_files(spark):
    rows = [r for r in EDGE if r[0] is not None and r != (12, "same id, other text")]
    folder = new_folder(spark, "tokens-test")
    manifest = ts.write_tokens(documents(spark, rows).repartition(5), PATH, folder, file_ids=500)
    assert manifest.count() > 3
    got = ts.read_tokens(spark, folder, with_ids=True)
    assert rows_of(got.drop("ids")) == expected(sorted(rows, key=lambda r: r[0]))
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in got.collect())


def test_null_and_repeated_ids_are_all_kept(spark):
    got = ts.round_trip(spark, documents(spark, EDGE), PATH).orderBy("start").collect()
    assert len(got) == len(EDGE)
    assert [r.doc_id for r in got] == sorted((r[0] for r in EDGE), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark):
    assert ts.round_trip(spark, documents(spark, []), PATH).collect() == []


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 31, 32])
def test_blocks_of_every_width(width):
    r = np.random.default_rng(width)
    ids = r.integers(0, 1 << width, 5000).astype(np.uint32)
    ids[r.integers(0, 5000, 200)] = np.uint32((1 << 32) - 1 if width < 32 else 7)  # outliers
    counts = np.array([0, 1, 4000, 0, 999, 0])
    f = ts.TokenFile(ts.encode_file(ids, [5, 6, None, -8, 9, 10], counts, 2))
    assert f.doc_ids == [5, 6, None, -8, 9, 10] and f.counts.tolist() == counts.tolist()
    assert (f.read(0, 5000) == ids).all()
    for a, b in [(0, 1), (1023, 1025), (3000, 3000), (2048, 4999), (4999, 5000)]:
        assert (f.read(a, b) == ids[a:b]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(1024, 3, np.uint32)
    plain = len(ts.encode_file(ids, [1], np.array([1024]), 2))
    ids[7] = 49_000
    assert len(ts.encode_file(ids, [1], np.array([1024]), 2)) == plain + 6


def test_refuses_vocabularies_that_keep_space():
    with pytest.raises(ValueError):
        ts.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
