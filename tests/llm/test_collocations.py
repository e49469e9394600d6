import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import EDGE, documents, rows_of, table
from pyspark.sql import functions as F

from ledgerlens.llm import collocations
from ledgerlens.llm.text import U64

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=30, depth=4, top=2000):
    """Counts of all phrases in a dictionary."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang, *w[i : i + k]] += 1
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    covered = set()
    for p, a in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                part = (p[0], *p[i : i + k])
                if 100 * a >= 80 * f[part]:
                    covered.add(part)
    by_lang = {}
    for p, a in found.items():
        if p in covered:
            continue
        cuts = [(2_000_000 * a // (f[p[:k]] + f[p[0], *p[k:]]), k) for k in range(2, len(p))]
        score, k = min(cuts)
        by_lang.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[p[0], *p[k:]]))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def collected(docs):
    return [(r.text, r.lang) for r in docs.select("text", "lang").collect()]


def test_whole_table(spark):
    docs = table(spark, "documents")
    got = collocations.mine(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(collected(docs))
    assert rows_of(got) == want and len(want) > 20


def prose(seed, n, vocabulary=25):
    r = random.Random(seed)
    words = [f"{'abcdé'[i % 5]}{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        out.append(r.choice(words[: r.choice((2, 5, vocabulary))]).upper() if r.random() < 0.1 else r.choice(words[: r.choice((2, 5, vocabulary))]))
        out.append(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " . "]))
    return "".join(out)


@pytest.mark.parametrize(("min_count", "depth"), [(30, 4), (1, 3), (7, 2), (12, 5)])
def test_dense_phrases(spark, min_count, depth):
    """Few words, so most pairs are heavier than an even share and are split."""
    rows = [(i, prose(i, 300), ["en", "de", None, "und"][i % 4]) for i in range(12)]
    docs = documents(spark, rows).repartition(3)
    assert rows_of(collocations.mine(docs, min_count, depth)) == brute(collected(docs), min_count, depth)


def test_small_buffers_and_routes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 97)
    monkeypatch.setattr(collocations, "PAIRS", 41)
    rows = [(i, prose(i, 400, 60)) for i in range(8)] + [(100 + i, "a hot passage of six words " * 40) for i in range(8)]
    docs = documents(spark, rows).repartition(4)
    want = brute(collected(docs))
    assert rows_of(collocations.mine(docs)) == want
    monkeypatch.setattr(collocations, "ROUTES_A_PARTITION", 0)  # one route for all
    assert rows_of(collocations.mine(docs)) == want


def test_top_of_each_lang(spark):
    docs = documents(spark, [(i, prose(i, 300), "ab"[i % 2]) for i in range(10)])
    assert rows_of(collocations.mine(docs, 5, 4, top=7)) == brute(collected(docs), 5, 4, 7)


def test_edge_rows(spark):
    rows = EDGE + [(50 + i, "x y z.Z x y z\x0bq q;q", "") for i in range(40)]
    docs = documents(spark, rows).repartition(4)
    got = rows_of(collocations.mine(docs))
    assert got == brute(collected(docs)) and any(r[0] == "" for r in got)


def test_empty_table_and_no_words(spark):
    assert collocations.mine(documents(spark, [])).collect() == []
    assert collocations.mine(documents(spark, [(1, None), (2, ""), (3, "..,,\n")])).collect() == []
    with pytest.raises(ValueError, match="two words"):
        collocations.mine(documents(spark, []), depth=1)


def test_clashing_columns(spark):
    docs = documents(spark, [(i, prose(i, 300)) for i in range(4)])
    more = docs.withColumns({c: F.lit(1) for c in ("word", "id", "f", "n", "phrase", "route", "score", "rank", "a", "l")})
    assert rows_of(collocations.mine(more)) == brute(collected(docs))


def test_counts_are_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    big = 2**62
    phrases = spark.createDataFrame([("en", ["x", "y", "z"], "x y z", big)], "lang string, words array<string>, phrase string, a bigint")
    parts = [("en", "x", big), ("en", "y z", big + 1), ("en", "x y", big + 2), ("en", "z", big)]
    counts = spark.createDataFrame(parts, "lang string, phrase string, f bigint")
    got = collocations._scored(phrases, counts).first()
    scores = [(2_000_000 * big // (2 * big + 1), 1), (2_000_000 * big // (2 * big + 2), 2)]
    assert got.score == min(scores)[0]
    assert (got.l, got.r) == ((big, big + 1) if min(scores)[1] == 1 else (big + 2, big))


def test_quicksort_abandons_and_counts():
    r = np.random.default_rng(3)
    columns = r.integers(1, 9, (4, 5000)).astype(U64)
    columns[2:, r.random(5000) < 0.3] = 0
    weight = r.integers(1, 4, 5000)
    phrases, counts = collocations.quicksort(columns, np.zeros(5000, np.int8), weight, 40)
    want = Counter()
    for p, w in zip(columns.T.tolist(), weight.tolist(), strict=True):
        for k in (2, 3, 4):
            if p[k - 1]:
                want[tuple(p[:k] + [0] * (4 - k))] += w
    assert dict(zip(map(tuple, np.array(phrases).tolist()), counts, strict=True)) == {p: f for p, f in want.items() if f >= 40}
