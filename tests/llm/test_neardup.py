import re

import pyarrow as pa
import pytest
from llm_cases import EDGE, documents, fetch, rows_of, sentence
from pyspark.sql import functions as F

from ledgerlens.llm import neardup
from ledgerlens.llm.components import components
from ledgerlens.llm.queries import op1_ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=80, gram=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + gram]) for i in range(max(1, len(w) - gram + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((r[0], len(s), low.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(seed, base, edits):
    import random

    r, w = random.Random(seed), base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_whole_table(spark):
    want = brute(fetch("documents", "doc_id, text"))
    assert rows_of(op1_ngram_join(spark, "/root/testdata/sf0.001")) == want
    assert sum(r[0] != r[2] for r in want) > 5


def test_edge_rows(spark):
    assert rows_of(neardup.near_duplicates(documents(spark, EDGE).repartition(4)).drop("tk", "component")) == brute(EDGE)


@pytest.mark.parametrize("seed", range(4))
def test_family_of_near_copies_at_the_threshold(spark, seed):
    """Members near and beyond the threshold: links through chains, missed pairs would show."""
    base = sentence(100 + seed, 120)
    rows = [(i, edited(i + 1000 * seed, base, i % 7)) for i in range(60)]
    chain = base
    for i in range(60, 80):
        chain = edited(i + seed, chain, 2)
        rows.append((i, chain))
    rows += [(200 + i, sentence(i, 4 + i)) for i in range(20)]
    got = rows_of(neardup.near_duplicates(documents(spark, rows).repartition(6)).drop("tk", "component"))
    assert got == brute(rows)


def test_other_parameters(spark):
    rows = [(i, edited(i, sentence(7, 60), i % 9)) for i in range(40)]
    got = neardup.near_duplicates(documents(spark, rows), gram=3, percent=65).drop("tk", "component")
    assert rows_of(got) == brute(rows, 65, 3)


def test_exact_threshold(spark):
    # two sets of 9 and 10 shingles sharing 8 (8/11 < 0.8); 8 of 10 shared is a link
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:12])), (2, " ".join(w[:14])), (3, " ".join(w[:15])), (4, " ".join([*w[:13], "z"]))]
    assert rows_of(neardup.near_duplicates(documents(spark, rows)).drop("tk", "component")) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert neardup.near_duplicates(documents(spark, [])).collect() == []
    docs = documents(spark, EDGE[:10]).withColumnsRenamed({"lang": "sig", "source": "n", "n_chars": "tk"})
    assert rows_of(neardup.near_duplicates(docs).drop("tk", "component")) == brute(EDGE[:10])


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(200, 260)} | {7: 7, 1: 1, 2: 1, 3: 1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_a_passage_of_one_document_a_task_is_no_rare_one(spark):
    """Every shingle is counted: one that no two texts of a task share comes after the others all the same."""
    passage = " ".join(f"common{i}" for i in range(12))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(40)) + " " + passage) for i in range(24)]
    docs = documents(spark, rows).repartitionByRange(24, "doc_id").select("doc_id", F.xxhash64("text").alias("tk"), "text")
    profiles = neardup._profiles(docs, 5).cache()
    place = neardup._cell_order(profiles)
    (_, _, sets, _), *_ = neardup.shingle_sets(pa.array([passage]), 5)
    cells = set(neardup._cell(sets[0]).tolist())
    assert {int(c) for c in place.argsort()[-len(cells) :]} == cells
    counts = profiles.where("cells IS NOT NULL").select(F.posexplode("cells").alias("cell", "c")).groupBy("cell").agg(F.sum("c").alias("c"))
    assert counts.agg(F.sum("c")).first()[0] == 24 * (52 - 4)  # each shingle of each text, once
    assert {r.cell: r.c for r in counts.where("c > 2").collect()} == {c: 24 for c in cells}


def test_keep_one_of_a_row_that_is_repeated_in_every_task(spark):
    hot = sentence(3, 80)
    rows = [(7, hot)] * 60 + [(None, hot + " x")] * 5 + [(i, sentence(1000 + i, 60)) for i in range(20)] + [(3, ""), (3, ""), (None, None)]
    kept = neardup.keep_one(documents(spark, rows).repartition(6))
    low = [(None, hot + " x")]  # a null id counts as the smallest
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(low + rows[65:], key=repr)
    aggregates = str(kept._jdf.queryExecution().sparkPlan()).count("partial_first")
    assert aggregates  # repeated rows are reduced before the shuffle
