"""Substring deduplication by level-wise doubling.

A window of ``window`` words that repeats contains shorter windows that repeat. Levels double in
length up to ``window``; only what repeats at one length is extended to twice that length, and
the levels end early when nothing is left.

At the first level (half the window) not every position has to be looked up: of the
consecutive short windows inside one full window it is enough to look up that with the smallest
hash, as an equal full window elsewhere has the same one. That leaves about one position in
seven. Full windows whose smallest short window repeats are extended and looked up at the full
length; a full window is removable where an equal one starts earlier in (doc_id, position)
order. Words covered by a removable window are removed.

A task looks up one row per hash of a group of texts: repeats inside the group are known at
once, and only the group's first occurrence has to be compared with the other groups'. So a
passage that a third of all documents share makes one row per group, not one per document.

Defined results: null text has no words; repeated rows (same id, same text) are one document and
each get its result; rows of one doc_id with different texts are ordered by a hash of the text; a
null doc_id comes before all others; other columns are ignored; an empty table gives an empty
result. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import NON_SPACE, U64, hash_words, mix, string_chunks, window_hashes, words

WINDOW = 20
FIRST = 10  # least length of the first level: shorter runs repeat by chance too often
_ROW = "h bigint, id bigint, at int, more binary"  # and th bigint (text hash) where ids are not unique


def levels(window: int) -> list[int]:
    """Lengths that double up to ``window``; the first is ``FIRST`` words or a little more."""
    doublings = 0
    while window >= FIRST << (doublings + 1):
        doublings += 1
    first = -(-window // (1 << doublings))
    return [min(window, first << k) for k in range(doublings + 1)]


def _chunks(column: pa.Array):
    for lo, hi, data, off in string_chunks(column):
        starts, ends, first = words(data, off, NON_SPACE)
        yield lo, hi, data, starts, ends, first


def _anchors(h: np.ndarray, group: int) -> np.ndarray:
    """For each group of consecutive hashes, the position of its smallest (first among equals)."""
    view = np.lib.stride_tricks.sliding_window_view(h, group)
    out = np.empty(len(view), np.int64)
    for i in range(0, len(view), 1 << 16):
        out[i : i + (1 << 16)] = view[i : i + (1 << 16)].argmin(axis=1)
    return out + np.arange(len(view))


def _looked_up(h: np.ndarray, own: np.ndarray, at: np.ndarray, ids: np.ndarray, th: np.ndarray, first_too: bool, unique: bool) -> pa.RecordBatch:
    """Rows to look up: the first occurrence of each hash in this group of texts; and one row
    per text with the places whose hash is known to repeat (``first_too``: firsts as well)."""
    order = np.lexsort((at, th[own], ids[own], h))
    h, own, at = h[order], own[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    # a repeated row is the same document, so its windows are no repeats of one another
    head = start[np.cumsum(new) - 1]
    same = (ids[own] == ids[own[head]]) & (th[own] == th[own[head]]) & (at == at[head])
    sure = ~same
    if first_too:
        several = np.zeros(len(h), bool)
        several[head[sure]] = True
        sure |= several[head]
    by = np.argsort(own[sure], kind="stable")
    places, owner = at[sure][by], own[sure][by]
    texts, begin = np.unique(owner, return_index=True)
    lists = np.split(places.astype("<i4"), begin[1:]) if len(texts) else []
    kept = start
    extra = len(texts)
    key = np.concatenate([h[kept], mix(ids[texts].astype(U64) ^ mix(th[texts].astype(U64)) ^ U64(0x5DEECE66D))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(np.concatenate([ids[own[kept]], ids[texts]])),
            pa.array(np.concatenate([at[kept], np.zeros(extra, np.int64)]).astype(np.int32)),
            pa.array([None] * len(kept) + [x.tobytes() for x in lists], pa.binary()),
            *([] if unique else [pa.array(np.concatenate([th[own[kept]], th[texts]]))]),
        ],
        ["h", "id", "at", "more"] + ([] if unique else ["th"]),
    )


def _spots(h: np.ndarray, window: int, first: int, length: int) -> np.ndarray:
    """For every full window of a document, the place of its window of ``length`` to look up:
    it lies in the full window and holds the anchor. ``h``: hashes of the first length."""
    full = np.arange(len(h) - (window - first))
    return np.minimum(_anchors(h, window - first + 1), full + window - length)


def _look_up(docs: DataFrame, window: int, lengths: list[int], level: int, unique: bool) -> DataFrame:
    """Windows of a level's length to be looked up, of documents (and, after the first level,
    of the full windows whose window of the previous length repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, starts, ends, first in _chunks(b.column(2)):
                wh = hash_words(data, starts, ends)
                h, now = window_hashes(wh, lengths[0]), window_hashes(wh, lengths[level])
                parts, owns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(np.diff(first) >= window).tolist():
                    a, e = int(first[i]), int(first[i + 1])
                    mine = h[a : e - lengths[0] + 1]
                    at = _spots(mine, window, lengths[0], lengths[level])
                    if level:
                        live = np.zeros(e - a, bool)
                        live[_places(b, lo + i)] = True
                        at = at[live[_spots(mine, window, lengths[0], lengths[level - 1])]]
                    at = np.unique(at)
                    parts.append(at)
                    owns.append(np.full(len(at), i))
                at, own = np.concatenate(parts), np.concatenate(owns)
                if len(at):
                    ids, th = (b.column(k).slice(lo, hi - lo).to_numpy() for k in (0, 1))
                    yield _looked_up(now[first[own] + at], own, at, ids, th, level < len(lengths) - 1, unique)

    return docs.mapInArrow(run, _ROW if unique else _ROW + ", th bigint")


def _by_document(rows: DataFrame, places: str) -> DataFrame:
    """Places of each document: single ones in an array, packed ones in an array of binaries."""
    return rows.groupBy("id", "th").agg(
        F.collect_list(F.when(F.col("more").isNull(), F.col("at"))).alias(places), F.collect_list("more").alias("packed")
    )


def _places(b: pa.RecordBatch, row: int) -> np.ndarray:
    """The places of a row as written by ``_by_document`` (columns 3 and 4 of the batch)."""
    single, packed = b.column(3)[row], b.column(4)[row]
    parts = [np.asarray(single.values, np.int32)] if single.is_valid else []
    parts += [np.frombuffer(x, "<i4") for x in packed.as_py()] if packed.is_valid else []
    return np.unique(np.concatenate([np.zeros(0, np.int32), *parts])).astype(np.int64)


def _removal(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Apply the removable windows: counts, digest, and the kept text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, starts, ends, first in _chunks(b.column(2)):
                total, gone, digest, kept_text = [], [], [], []  # one entry per row
                for i in range(hi - lo):
                    a, e = int(first[i]), int(first[i + 1])
                    at = _places(b, lo + i)
                    step = np.bincount(at, minlength=e - a + 1) - np.bincount(at + window, minlength=e - a + 1)
                    keep = np.cumsum(step)[:-1] == 0
                    s, t = starts[a:e][keep].tolist(), ends[a:e][keep].tolist()
                    joined = b" ".join([data[x:y].tobytes() for x, y in zip(s, t, strict=True)]) if len(s) < 64 else _joined(data, starts[a:e][keep], ends[a:e][keep])
                    total.append(e - a)
                    gone.append(e - a - len(s))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    if with_text:
                        kept_text.append(joined.decode() if len(s) < e - a else b.column(2)[lo + i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(5).slice(lo, hi - lo),
                        pa.array(total, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(digest),
                        *([pa.array(kept_text, pa.string())] if with_text else []),
                        *([c.slice(lo, hi - lo) for c in b.columns[6:]] if with_text else []),
                    ],
                    [f"r{k}" for k in range(4 + with_text + (b.num_columns - 6) * with_text)],
                )

    extra = docs.schema.fields[6:] if with_text else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = [f"r0 {kind}", "r1 bigint", "r2 bigint", "r3 string"] + ["r4 string"] * with_text
    shape += [f"r{5 + k} {f.dataType.simpleString()}" for k, f in enumerate(extra)]
    return docs.mapInArrow(run, ", ".join(shape))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space, without a Python object per word."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    shift = np.repeat(starts - to[:-1], size)
    where = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[where] = data[where + shift]
    return out[:-1].tobytes()


def _key(docs: DataFrame) -> tuple[list[Column], bool]:
    """(id, th), the document, and whether every id is there once (one look at the ids). The text's
    64-bit hash tells rows of one id apart; with unique ids it is 0 and not in the looked-up rows."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    twice = docs.groupBy(key.alias("id")).count().where("count > 1")
    unique = twice.isEmpty()
    return [key.alias("id"), (F.lit(0).cast("bigint") if unique else F.xxhash64("text")).alias("th")], unique


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``with_text`` also
    ``kept_text`` (the kept words joined by one space, or the text as it is where all are kept) and
    the columns ``keep``."""
    lengths = levels(window)
    key, unique = _key(docs)
    base = docs.select(*key, "text", "doc_id", *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    th = F.lit(0).cast("bigint") if unique else F.col("th")
    order = Window.partitionBy("h").orderBy(*["id", "at"] if unique else ["id", "th", "at"])
    looked = _look_up(base.select("id", "th", "text"), window, lengths, 0, unique)
    for level in range(len(lengths)):
        # every join below plans the same exchange of the texts, which runs once
        seen = looked.select("id", th.alias("th"), "at", "more", F.rank().over(order).alias("r"), F.lead("id").over(order).alias("next"))
        repeats = F.col("more").isNotNull() | (F.col("r") > 1)
        last = level == len(lengths) - 1
        if not last:  # an occurrence that sorts first repeats as well
            repeats |= F.col("next").isNotNull()
        found = _by_document(seen.where(repeats).select("id", "th", "at", "more"), "spots")
        rows = base.join(found, ["id", "th"], "left" if last else "inner")
        rows = rows.select("id", "th", "text", "spots", "packed", "doc_id", *[f"k{i}" for i in range(len(keep))])
        if not last:
            looked = _look_up(rows, window, lengths, level + 1, unique)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept_text", *keep] if with_text else [])
    return _removal(rows, window, with_text).toDF(*names)
