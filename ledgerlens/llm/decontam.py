"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash of ``k`` consecutive words in a sliding group of
``window - k + 1`` such hashes, so two texts that share ``window`` words share a fingerprint.
Training documents and benchmark items are fingerprinted, fingerprints are joined, and every
joined fingerprint is extended: the windows of ``window`` words around it are compared with the
item windows. Items shorter than ``window`` words are one window of their own length; documents
are compared at those few lengths directly.

The document side is first thinned by a bit table of the item hashes. Its size is fixed, so
the broadcast does not grow; it has no false negatives, and what it lets through is decided by
the joins, so results do not depend on it.

Defined results: null or wordless documents have no words and no hits; null or wordless items
never occur; repeated documents are judged row by row, repeated items and equal item texts each
count (a repeated item id once); other columns are ignored; with an empty benchmark nothing is
contaminated. Windows are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, in_table
from .storage import cut
from .text import ALNUM, LOWER, U64, hash_words, mix, ragged, string_chunks, window_hashes, words

WINDOW = 10
GRAM = 4


def _word_chunks(column: pa.Array):
    """Row range, word hashes and each row's first word, for consecutive rows."""
    for lo, hi, data, off in string_chunks(column):
        low = LOWER[data]
        starts, ends, first = words(low, off, ALNUM)
        yield lo, hi, hash_words(low, starts, ends), first


def fingerprints(grams: np.ndarray, group: int) -> np.ndarray:
    """Positions of the smallest hash of every ``group`` consecutive ones (last among equals)."""
    if len(grams) < group:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], group)[::-1]
    at = np.arange(len(view)) + group - 1 - view.argmin(axis=1)
    return np.unique(at)


def _sized(h: np.ndarray, n: int) -> np.ndarray:
    """Window hashes that differ between lengths."""
    return mix(h ^ U64(n))


def _items(benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of long items; windows of all items with their length and item id)."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, np.ndarray, np.ndarray, int]] = []
            for lo, hi, h, first in _word_chunks(b.column(1)):
                for i in range(hi - lo):
                    w = h[first[i] : first[i + 1]]
                    if len(w) >= window:
                        rows.append((lo + i, _sized(window_hashes(w, window), window), window_hashes(w, gram)[fingerprints(window_hashes(w, gram), window - gram + 1)], window))
                    elif len(w):
                        rows.append((lo + i, _sized(window_hashes(w, len(w)), len(w)), np.zeros(0, U64), len(w)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([np.unique(r[1]).view(np.int64) for r in rows], pa.list_(pa.int64())),
                    pa.array([np.unique(r[2]).view(np.int64) for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                ["item_id", "windows", "prints", "len"],
            )

    out = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, windows array<bigint>, prints array<bigint>, len int")
    return (
        out.select(F.explode("prints").alias("print")).distinct(),
        out.select("item_id", "len", F.explode("windows").alias("hash")).distinct(),
    )


def _candidates(docs: DataFrame, prints: np.ndarray, windows: np.ndarray, short: list[int], window: int, gram: int) -> DataFrame:
    """One row per document: its words, fingerprints that may be an item's, and for each of
    them the windows around it (start and hash) that may be an item's; likewise short windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    group = window - gram + 1

    def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, first in _word_chunks(b.column(2)):
                n = np.diff(first)
                own = np.repeat(np.arange(hi - lo), n)
                last = first[1:][own] if len(own) else own  # end of each word's document

                def inside(at: np.ndarray, size: int, last=last) -> np.ndarray:
                    return at[at + size <= last[at]]

                # long items: winnow each document, keep prints that an item may have
                grams = window_hashes(h, gram)
                ok = np.zeros(len(h), bool)
                ok[: len(grams)] = True
                at = inside(np.flatnonzero(ok), gram)
                hit_print, hit_from, hit_start, hit_hash, hit_len = [], [], [], [], []
                hot = np.zeros(len(h), bool)
                hot[at] = in_table(prints, grams[at])
                if hot.any():
                    for i in np.unique(own[hot]).tolist():
                        a, e = int(first[i]), int(first[i + 1])
                        p = a + fingerprints(grams[a : e - gram + 1], group)
                        p = p[hot[p]]
                        if not len(p):
                            continue
                        low = np.maximum(a, p - (window - gram))
                        high = np.minimum(e - window, p)
                        count = np.maximum(high - low + 1, 0)
                        start = ragged(low, count)
                        size = int(start.max() - start.min()) + window if len(start) else 0
                        if not size:
                            continue
                        base = int(start.min())
                        full = _sized(window_hashes(h[base : base + size], window), window)[start - base]
                        keep = in_table(windows, full)
                        hit_print.append(grams[np.repeat(p, count)][keep])
                        hit_from.append(np.full(int(keep.sum()), i))
                        hit_start.append((start - a)[keep])
                        hit_hash.append(full[keep])
                        hit_len.append(np.full(int(keep.sum()), window))
                # short items: every run of their few lengths
                for size in short:
                    full = window_hashes(h, size)
                    s = inside(np.arange(len(full)), size)
                    s = s[in_table(windows, _sized(full[s], size))] if len(s) else s
                    hit_print.append(np.zeros(len(s), U64))
                    hit_from.append(own[s])
                    hit_start.append(s - first[own[s]])
                    hit_hash.append(_sized(full[s], size))
                    hit_len.append(np.full(len(s), size))
                src = np.concatenate([*hit_from, np.zeros(0, np.int64)]).astype(np.int64)
                order = np.argsort(src, kind="stable")
                count = np.bincount(src, minlength=hi - lo)
                get = lambda parts, empty, order=order: np.concatenate([*parts, np.zeros(0, empty)])[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        b.column(1).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        listed(get(hit_print, U64).view(np.int64), count, pa.int64()),
                        listed(get(hit_start, np.int64), count, pa.int32()),
                        listed(get(hit_hash, U64).view(np.int64), count, pa.int64()),
                        listed(get(hit_len, np.int64), count, pa.int32()),
                    ],
                    ["doc_id", "tk", "n_words", "print", "start", "hash", "len"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("tk"), "text").mapInArrow(
        run, f"doc_id {kind}, tk bigint, n_words bigint, print array<bigint>, start array<int>, hash array<bigint>, len array<int>"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings) and spans of every row of ``docs``; then
    ``tk``, a hash of its text."""
    spark = docs.sparkSession
    prints, windows = _items(benchmark, window, gram)
    windows = cut(spark, windows, "item-windows")
    prints = cut(spark, prints, "item-prints")
    print_bits = bit_table(prints, "print")
    window_bits = bit_table(windows, "hash")
    short = [r.len for r in windows.where(F.col("len") < window).select("len").distinct().collect()]  # under `window` rows
    rows = _candidates(docs, print_bits, window_bits, sorted(short), window, gram)
    rows = cut(spark, rows.withColumn("row", F.monotonically_increasing_id()), "document-candidates")

    flat = rows.select("row", F.explode(F.arrays_zip("print", "start", "hash", "len")).alias("x")).select("row", "x.*")
    by_print = flat.where(F.col("len") == window).join(prints, "print", "left_semi")
    found = by_print.unionByName(flat.where(F.col("len") < window)).select("row", "start", "hash", "len").distinct()
    by_window = windows.groupBy("hash", "len").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = found.join(by_window, ["hash", "len"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    judged = hits.select("row", covered.alias("n_hit"), "items", "spans")
    out = rows.select("row", "doc_id", "tk", "n_words").join(judged, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        "tk",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window."""
    hit = contamination(docs, benchmark).where("n_hit > 0").select("doc_id", "tk").distinct()
    gone = (docs["doc_id"].eqNullSafe(hit["doc_id"])) & (F.xxhash64(docs["text"]) == hit["tk"])
    return docs.join(hit, gone, "left_anti")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of ``contamination``."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
