import hashlib
import re

import pytest
from llm_cases import EDGE, documents, fetch, rows_of, sentence
from pyspark.sql import functions as F

from ledgerlens.llm import substring
from ledgerlens.llm.queries import op3_substring_dedup


def brute(rows, window=20):
    """Windows in (doc_id, text hash order, start) order; identical rows are one document."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    unique = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for k, (_, text) in enumerate(unique):
        w = split(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (k, i))
    result = {}
    for k, row in enumerate(unique):
        w = split(row[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        digest = hashlib.sha256(kept.encode()).hexdigest()
        result[row] = (row[0], len(w), sum(gone), digest, kept if any(gone) else row[1])
    return sorted((result[r] for r in rows), key=repr)


def digests(expected):
    return sorted((r[:4] for r in expected), key=repr)


def test_whole_table(spark):
    want = digests(brute(fetch("documents", "doc_id, text")))
    assert rows_of(op3_substring_dedup(spark, "/root/testdata/sf0.001")) == want
    assert sum(r[2] > 0 for r in want) > 5


def test_edge_rows(spark):
    rows = [r for r in EDGE if r not in [(12, "same id, other text")]]
    assert rows_of(substring.remove_repeats(documents(spark, rows).repartition(4))) == digests(brute(rows))


@pytest.mark.parametrize("window", [5, 20, 21, 47])
def test_other_lengths(spark, window):
    shared = sentence(9, 60)
    rows = [(i, sentence(i, 30 + i) + " " + shared[: 200 - 10 * i] + " " + sentence(i + 50, 25) + " " + shared) for i in range(8)]
    got = substring.remove_repeats(documents(spark, rows).repartition(3), window=window, with_text=True, keep=("lang",)).drop("lang")
    assert rows_of(got) == brute(rows, window)


def test_levels_double():
    assert substring.levels(20) == [10, 20]
    assert substring.levels(80) == [10, 20, 40, 80]
    assert substring.levels(50) == [13, 26, 50]
    assert substring.levels(7) == [7]


def test_windows_are_judged_on_the_input(spark):
    """A removed passage still removes its later copies, and parts of windows do not."""
    a, b = sentence(20, 30), sentence(21, 30)
    rows = [(1, a), (2, a + " " + b), (3, b + " " + a), (4, " ".join(a.split()[:19]))]
    assert rows_of(substring.remove_repeats(documents(spark, rows))) == digests(brute(rows))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_id_with_the_same_32_bit_hash(spark, doc_id):
    shared = sentence(30, 30)
    numbered = spark.range(400_000).select(F.col("id").alias("n"), F.concat(F.col("id").cast("string"), F.lit(" " + shared)).alias("text"))
    pair = numbered.groupBy(F.hash("text")).agg(F.collect_list("text").alias("two")).where(F.size("two") > 1).first().two[:2]
    total = len(pair[0].split())
    got = rows_of(substring.remove_repeats(documents(spark, [(doc_id, t) for t in pair])))
    assert [r[:2] for r in got] == [(doc_id, total)] * 2
    assert sorted(r[2] for r in got) == [0, total - 1]  # one of the two starts later and loses the passage


def test_empty_table_and_clashing_columns(spark):
    assert substring.remove_repeats(documents(spark, [])).collect() == []
    docs = documents(spark, EDGE[:10]).withColumnsRenamed({"lang": "id", "source": "th", "n_chars": "spots"})
    assert rows_of(substring.remove_repeats(docs)) == digests(brute(EDGE[:10]))
