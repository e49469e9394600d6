import hashlib
import re

import numpy as np
import pytest
from llm_cases import EDGE, documents, fetch, rows_of, sentence, table

from ledgerlens.llm import decontam
from ledgerlens.llm.queries import op6_decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    where = {}
    for item_id, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else []:
            where.setdefault((n, tuple(w[i : i + n])), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, found = np.zeros(len(w), bool), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if ids := where.get((n, tuple(w[i : i + n]))):
                    hit[i : i + n] = True
                    found |= ids
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit.any())))
    return sorted(out, key=repr)


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_whole_tables(spark):
    want = brute(fetch("documents", "doc_id, text"), fetch("benchmark", "item_id, text"))
    assert rows_of(op6_decontamination(spark, "/root/testdata/sf0.001")) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_edge_rows(spark):
    base = sentence(1, 300).split()
    items = [
        (1, " ".join(base[40:70])),
        (2, " ".join(base[5:15]).upper()),  # exactly one window
        (3, "one"),
        (4, "two THREE"),
        (5, None),
        (6, "?!"),
        (7, "a a a"),
        (8, " ".join(base[100:109])),  # one word short of a window
        (9, " ".join(base[40:70])),  # a copy under another id
        (9, " ".join(base[40:70])),
        (10, "x" * 20_000),
        (None, "日本語 😀"),
    ]
    got = decontam.contamination_digest(documents(spark, EDGE), items_frame(spark, items))
    assert rows_of(got) == brute(EDGE, items)


@pytest.mark.parametrize("offset", range(0, 24, 3))
def test_every_shared_span_of_ten_words_is_found(spark, offset):
    shared = [f"s{i}" for i in range(10)]
    docs = [(1, " ".join([f"d{i}" for i in range(offset)] + shared + [f"e{i}" for i in range(7)]))]
    items = [(1, " ".join([f"x{i}" for i in range(13 - offset // 2)] + shared + ["z"]))]
    got = decontam.contamination(documents(spark, docs), items_frame(spark, items)).collect()[0]
    assert got.n_hit == 10 and got["items"] == ["1"] and [tuple(s) for s in got.spans] == [(offset, offset + 10)]


def test_empty_tables(spark):
    docs, items = documents(spark, EDGE), items_frame(spark, [])
    assert {r.n_hit for r in decontam.contamination(docs, items).collect()} == {0}
    assert decontam.contamination(documents(spark, []), table(spark, "benchmark")).collect() == []


def test_clashing_columns(spark):
    docs = table(spark, "documents").withColumnRenamed("source", "n_hit").withColumnRenamed("lang", "row")
    items = table(spark, "benchmark").selectExpr("*", "1 AS len", "2 AS hash")
    assert rows_of(decontam.contamination_digest(docs, items)) == rows_of(op6_decontamination(spark, "/root/testdata/sf0.001"))


def test_winnowing_keeps_one_minimum_per_group():
    h = np.array([5, 3, 9, 3, 8, 7, 1, 2], np.uint64)
    got = decontam.fingerprints(h, 3).tolist()
    assert got == [1, 3, 6]
