"""Phrase collocations by multikey quicksort of suffix pointers.

A suffix pointer is a word position with the words that follow it in its piece, at most ``depth`` of
them. Pointers are routed by their leading words, each route is sorted by a three-way quicksort
that goes one word deeper in the equal part, and the weight of an equal part at depth d is the
count of the phrase of its first d words. A part lighter than ``min_count`` is abandoned.

Before routing, what can't reach ``min_count`` is left out by global counts: words first, then
leading pairs. The tables that tell it to the scans have a fixed size and no false negatives (see
``bits.py``), so they only spare work: the counts come from the sorted parts.

Pointers and counts of a scan are added up and shipped in blocks, one row per scan buffer and route
(``blocks.py``). A route holds all pointers of its leading pairs, so its counts are whole. A pair heavier than an
even share of the routes is split: its pointers are cut off after two, three and four words, each
kind is routed by all its words, added up in the scan (a pair, and mostly a triple, is then one row
a task) and counts at its own depth alone. There are as many routes as the pointers ask for, and a
task holds one route at a time.

Scores: each phrase is joined with the counts of its parts; a part of a frequent phrase is
frequent, so all of them are known. Arithmetic is in 38 digits.

Defined results: a null text has no words; a null lang is ``und``; repeated rows count again;
doc_id and other columns are ignored; documents without words give no rows. Words are told apart by
a 64-bit hash of lang and word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, in_table
from .blocks import block_sql, bucket_width, by_bucket, pack, unpack
from .storage import cut
from .text import LOWER, U64, hash_words, mix, ragged, string_chunks, window_hashes, words

MIN_COUNT = 30
DEPTH = 4
TOP = 2000
FACTOR = 2_000_000  # of the score
COVER = (80, 100)  # a longer phrase that occurs so many times of so many covers its parts
ROUTE = 1_000_000  # pointers a route should hold
ROUTES_A_PARTITION = 4
BUFFER = 1_000_000  # pointers of a scan that are added up together
PAIRS = 2_000_000  # pairs of a scan that are counted together, and of a bucket
SPREAD = 64  # parts of a lang that are cut to the top on their own first

_SPLIT = np.zeros(256, bool)  # ends a piece
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_SPLIT
_WORD[[0x20, 0x09]] = False
_A = U64(0x9E3779B97F4A7C55)  # odd


class Words:
    """The words of some documents: ids by lang and word, and which stand next to each other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, firsts = words(self.data, offsets, _WORD)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        self.ids = mix(hash_words(self.data, self.starts, self.ends) + seeds[self.doc]) | U64(1)  # 0 is no word
        piece = np.cumsum(_SPLIT[self.data], dtype=np.int64)[self.starts] if len(self.starts) else self.starts
        self.next = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])

    def texts(self, at: np.ndarray) -> pa.Array:
        size = self.ends[at] - self.starts[at]
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        joined = self.data[ragged(self.starts[at], size)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(joined)).cast(pa.string())

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of consecutive words, and where both are frequent and of one piece."""
        if len(self.ids) < 2:
            return np.zeros(0, U64), np.zeros(0, bool)
        known = in_table(frequent, self.ids)
        return window_hashes(self.ids, 2), self.next & known[1:] & known[:-1]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    """Words of each chunk, the lang number of each of its documents, and the langs."""
    for b in batches:
        lang = pc.fill_null(b.column(1), "und").dictionary_encode()
        number = lang.indices.to_numpy()
        seeds = np.array([int.from_bytes(sha256(x.encode()).digest()[:8], "little") for x in lang.dictionary.to_pylist()], U64)
        for lo, hi, data, off in string_chunks(b.column(0)):
            yield Words(data, off, seeds[number[lo:hi]]), number[lo:hi], lang.dictionary


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _count_words(docs: DataFrame, min_count: int) -> DataFrame:
    """lang, id, word, f of the frequent words; and with a null word, the count of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, number, langs in _batches(batches):
            ids, at, f = np.unique(w.ids, return_index=True, return_counts=True)
            total = np.bincount(number[w.doc], minlength=len(langs))
            have = np.flatnonzero(total)
            lang = pa.concat_arrays([langs.take(pa.array(number[w.doc[at]])), langs.take(pa.array(have))])
            word = pa.concat_arrays([w.texts(at), pa.nulls(len(have), pa.string())])
            columns = [lang, _signed(np.concatenate([ids, np.zeros(len(have), U64)])), word, pa.array(np.concatenate([f, total[have]]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "id", "word", "f"])

    found = docs.mapInArrow(run, "lang string, id bigint, word string, f bigint").groupBy("lang", "id", "word").agg(F.sum("f").alias("f"))
    return found.where((F.col("f") >= min_count) | F.col("word").isNull())


PAIR_KINDS = ("<u8", "<i4")


def _count_pairs(docs: DataFrame, frequent: np.ndarray, min_count: int, buckets: int) -> DataFrame:
    """pair, f of the frequent pairs: blocks of counts are dealt by the hash and added up."""
    width = bucket_width(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def ship() -> pa.RecordBatch:
            pair, f = np.unique(np.concatenate(held), return_counts=True)
            return pack(pair // width, [pair, f], PAIR_KINDS)

        for w, _, _ in _batches(batches):
            h, ok = w.pairs(frequent)
            held.append(h[ok])
            n += len(held[-1])
            if n >= PAIRS:
                yield ship()
                held, n = [], 0
        if n:
            yield ship()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, f in unpack(batches, PAIR_KINDS):
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            total = np.add.reduceat(f[order].astype(np.int64), first)
            keep = total >= min_count
            yield pa.RecordBatch.from_arrays([_signed(pair[first][keep]), pa.array(total[keep])], ["pair", "f"])

    return by_bucket(docs.mapInArrow(scan, block_sql(PAIR_KINDS))).mapInArrow(add_up, "pair bigint, f bigint")


def _chain(columns: np.ndarray) -> np.ndarray:
    """One hash of several columns of ids."""
    out = np.zeros(columns.shape[1], U64)
    for c in columns:
        out = (out + c) * _A
    return mix(out)


def _added_up(columns: np.ndarray, least: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal pointers as one with their weight, in the order of the hash that routes them: that of
    the leading pair, or of all words for those that count at one depth alone."""
    h = _chain(columns) + least.astype(U64)
    by = np.where(least == 0, _chain(columns[:2]), h)
    order = np.lexsort((h, by))
    columns, least, weight, by = columns[:, order], least[order], weight[order], by[order]
    new = np.ones(len(by), bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0) | (least[1:] != least[:-1])
    at = np.flatnonzero(new)
    return columns[:, at], least[at], np.add.reduceat(weight, at) if len(at) else weight, by[at]


def _kinds(depth: int) -> tuple[str, ...]:
    return ("<u8",) * depth + ("i1", "<i4")


def _pointers(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, heavy: np.ndarray, depth: int, routes: int) -> DataFrame:
    width = bucket_width(routes)

    def ship(columns: np.ndarray, least: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        columns, least, weight, by = _added_up(columns, least, weight)
        return pack(by // width, [*columns, least, weight], _kinds(depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w, _, _ in _batches(batches):
            h, ok = w.pairs(frequent)
            ok &= in_table(pairs, h)
            at = np.flatnonzero(ok)
            columns = np.zeros((depth, len(at)), U64)
            columns[0], columns[1] = w.ids[at], w.ids[at + 1]
            going = np.ones(len(at), bool)
            for d in range(2, depth):
                inside = at + d - 1 < len(ok)
                going &= inside
                going[going] = ok[at[going] + d - 1]
                columns[d, going] = w.ids[at[going] + d]
            split = in_table(heavy, h[at])
            kinds = [(columns[:, ~split], 0)]
            if split.any():
                for d in range(2, depth + 1):  # one pointer a depth, that counts there alone
                    part = columns[:, split]
                    part = part[:, part[d - 1] != 0].copy()
                    part[d:] = 0
                    kinds.append((part, d))
            for part, d in kinds:
                for lo in range(0, part.shape[1], BUFFER):
                    piece = part[:, lo : lo + BUFFER]
                    held.append((piece, np.full(piece.shape[1], d, np.int8), np.ones(piece.shape[1], np.int64)))
                    n += piece.shape[1]
                    if n >= BUFFER:
                        yield ship(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
                        held, n = [], 0
        if n:
            yield ship(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))

    return docs.mapInArrow(run, block_sql(_kinds(depth)))


def quicksort(columns: np.ndarray, least: np.ndarray, weight: np.ndarray, min_count: int) -> tuple[list[np.ndarray], list[int]]:
    """Phrases (ids, 0 after the last word) of two words or more and their counts.

    ``columns`` holds a row per depth; a pointer counts from depth ``least`` on.
    """
    depth = len(columns)
    phrases, counts = [], []
    todo = [(np.arange(columns.shape[1]), 0)]
    while todo:
        part, d = todo.pop()
        if weight[part].sum() < min_count:
            continue
        key = columns[d, part]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        below, above = key < pivot, key > pivot
        todo += [(part[below], d), (part[above], d)]
        if pivot == 0:  # pointers that end here
            continue
        equal = part[~(below | above)]
        if d >= 1:
            w = weight[equal]
            f = int(w[least[equal] <= d + 1].sum())
            if f >= min_count:
                phrase = columns[:, equal[0]].copy()
                phrase[d + 1 :] = 0
                phrases.append(phrase)
                counts.append(f)
        if d + 1 < depth:
            todo.append((equal, d + 1))
    return phrases, counts


def _sorted_routes(pointers: DataFrame, depth: int, min_count: int) -> DataFrame:
    """w1, w2, ..., f of every phrase that occurs ``min_count`` times."""
    names = [f"w{i + 1}" for i in range(depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, least, weight in unpack(batches, _kinds(depth)):
            phrases, counts = quicksort(np.stack(columns), least, weight.astype(np.int64), min_count)
            found = np.array(phrases, U64).reshape(len(phrases), depth).T
            cells = [*(_signed(np.ascontiguousarray(c)) for c in found), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, [*names, "f"])

    return by_bucket(pointers).mapInArrow(run, ", ".join(f"{x} bigint" for x in names) + ", f bigint")


def _named(phrases: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """lang, words, phrase, a: the phrases' words by their ids."""
    out = phrases
    for i in range(depth):
        word = known.select(F.col("id").alias(f"w{i + 1}"), F.col("word").alias(f"t{i + 1}"), *([F.col("lang")] if i == 0 else []))
        out = out.join(word, f"w{i + 1}", "inner" if i < 2 else "left")
    text = F.array_compact(F.array(*[f"t{i + 1}" for i in range(depth)]))
    return out.select("lang", text.alias("words"), F.array_join(text, " ").alias("phrase"), F.col("f").alias("a"))


def _wide(c):
    return (F.lit(c) if isinstance(c, int) else F.col(c)).cast("decimal(38,0)")


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase with its lowest-scoring cut (the earliest of equal ones)."""
    size = F.size("words")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("right"),
    )
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.toDF("lang", side, f), ["lang", side])
    score = F.call_function("div", _wide(FACTOR) * _wide("a"), _wide("l") + _wide("r")).cast("bigint")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: the count of the most frequent longer phrase around each part."""
    size = F.size("words")
    longer = phrases.where(size > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("len"))
    spread = longer.select("lang", "words", "a", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    parts = spread.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("phrase"), "a")
    return parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, top: int = TOP, cover: tuple[int, int] = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang."""
    if depth < 2 or min_count < 1:
        raise ValueError("a phrase has two words or more and occurs once or more")
    spark = docs.sparkSession
    texts = docs.select("text", "lang")
    vocabulary = cut(spark, _count_words(texts, min_count), "words")
    known = vocabulary.where("word IS NOT NULL")
    frequent = bit_table(known, "id")
    least = max(1, ROUTES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    all_words = vocabulary.where("word IS NULL").agg(F.sum("f")).first()[0] or 0
    pairs = cut(spark, _count_pairs(texts, frequent, min_count, max(least, -(-all_words // PAIRS))), "pairs")
    total = pairs.agg(F.sum("f")).first()[0] or 0
    routes = max(least, -(-total // ROUTE))
    heavy = bit_table(pairs.where(F.col("f") > max(min_count, total // routes)), "pair")
    pointers = _pointers(texts, frequent, bit_table(pairs, "pair"), heavy, depth, routes)
    found = cut(spark, _sorted_routes(pointers, depth, min_count), "phrases")
    phrases = cut(spark, _named(found, known, depth), "named")
    counts = known.select("lang", "word", "f").unionAll(phrases.select("lang", "phrase", "a"))
    held = _scored(phrases, counts).join(_covered(phrases), ["lang", "phrase"], "left")
    covered = F.coalesce(_wide(cover[1]) * _wide("most") >= _wide(cover[0]) * _wide("a"), F.lit(False))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("spread")
    parts = Window.partitionBy("lang", "spread").orderBy(*order)
    best = held.where(~covered).select("*", spread).withColumn("nth", F.row_number().over(parts)).where(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = vocabulary.where("word IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS p
  FROM documents
), listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, unnest(range(1, {DEPTH + 1})) AS s(k) WHERE len(w) >= k)
  GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= {MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, ({FACTOR}::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM found) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM found))
), covered AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN covered c USING (lang, phrase)
  WHERE coalesce({COVER[1]}::HUGEINT * c.most < {COVER[0]}::HUGEINT * best.a, true)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN totals USING (lang) WHERE rank <= {TOP}
"""
