"""Numpy columns in rows of binary cells, dealt by bucket: few large rows in place of many small ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import U64

Kinds = Sequence[str]


def bucket_width(buckets: int) -> np.uint64:
    """Hashes divided by it are bucket numbers below ``buckets``, in the order of the hashes."""
    return U64((1 << 64) // buckets + 1) if buckets > 1 else U64((1 << 64) - 1)


def block_sql(kinds: Kinds) -> str:
    return "bucket bigint, " + ", ".join(f"c{i} binary" for i in range(len(kinds)))


def pack(bucket: np.ndarray, columns: Sequence[np.ndarray], kinds: Kinds) -> pa.RecordBatch:
    """A row per bucket; ``bucket`` is sorted."""
    at = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *at.tolist(), len(bucket)] if len(bucket) else []
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    cells = [pa.array(bucket[[lo for lo, _ in spans]].astype(np.int64) if spans else [], pa.int64())]
    for c, kind in zip(columns, kinds, strict=True):
        c = np.ascontiguousarray(c).astype(kind, copy=False)
        cells.append(pa.array([c[lo:hi].tobytes() for lo, hi in spans], pa.binary()))
    return pa.RecordBatch.from_arrays(cells, ["bucket", *[f"c{i}" for i in range(len(kinds))]])


def by_bucket(blocks: DataFrame) -> DataFrame:
    """All rows of a bucket together, bucket by bucket."""
    return blocks.repartition("bucket").sortWithinPartitions("bucket")


def unpack(batches: Iterator[pa.RecordBatch], kinds: Kinds) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket in turn; one bucket is held at a time."""
    now, parts = None, []

    def joined() -> list[np.ndarray]:
        return [np.frombuffer(b"".join(cells), kind) for cells, kind in zip(zip(*parts, strict=True), kinds, strict=True)]

    for b in batches:
        for i, bucket in enumerate(b.column(0).to_pylist()):
            if bucket != now:
                if parts:
                    yield joined()
                now, parts = bucket, []
            parts.append([b.column(1 + j)[i].as_py() for j in range(len(kinds))])
    if parts:
        yield joined()
