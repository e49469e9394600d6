"""Exact top-k inner-product search by columnar branch and bound.

Vectors are quantised to integers and kept in blocks, dimension by dimension (all first
components, then all second ones, and so on). A query adds up its products with a candidate block
a few dimensions at a time. What is still to come is at most the product of the norms of the
two vectors' remaining components; candidates that cannot reach the query's k-th best score so
far are compacted away before the next dimensions are read. Every score that is returned was
summed in full, and a candidate that ties with the k-th best is kept, so results are exact.

Query blocks meet candidate blocks through a join on a lane number: candidates are dealt over
the lanes (as many as their blocks ask for), query blocks are repeated in each. One task holds one block of either side and the best
k of one query block.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a
null ``vec_id`` take no part; vectors of different lengths have no score; a query's own row is
left out, but a repeated row is another row; other columns are ignored; scores are exact (beyond
53 bits by integer objects), and those outside a BIGINT are its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

K = 5
QUERY_EVERY = 50
SCALE = 256
STEP = 16  # dimensions added up between two comparisons with the bound
QUERY_BLOCK = 512
BLOCK = 4096
LANES = 64  # tasks that a query block is sent to, at least
BLOCKS_A_LANE = 64  # candidate blocks that one of them reads; larger tables have more lanes


def _quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) / SCALE, which a double holds exactly for every finite x."""
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * values) / SCALE
    return np.where(np.isfinite(whole), whole, values)


def _integers(cells: np.ndarray) -> np.ndarray:
    """SCALE * cells, as Python integers if some are beyond the doubles."""
    with np.errstate(over="ignore"):
        out = SCALE * cells
    if np.isfinite(out).all():
        return out
    return np.array([[int(SCALE * x) if abs(x) < 2.0**1000 else SCALE * int(x) for x in row] for row in cells], object).reshape(cells.shape)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack vectors of one length into blocks: dim, n, vec_ids, row numbers, quantised columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            columns = np.array([v for _, _, v in part]).reshape(len(part), dim).T
            cells = [dim, len(part), *(np.array([p[i] for p in part], "<i8").tobytes() for i in (0, 1)), np.ascontiguousarray(columns).astype("<f8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["dim", "n", "ids", "rows", "cells"])

        for b in batches:
            values = b.column(2)
            off, flat = np.asarray(values.offsets), _quantised(np.asarray(values.values, np.float64))
            for i, (vec, row) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                v = flat[off[i] : off[i + 1]]
                held.setdefault(len(v), []).append((vec, row, v))
                if len(held[len(v)]) == size:
                    yield pack(len(v))
        for dim in list(held):
            yield pack(dim)

    return rows.select("vec_id", "row", "embedding").mapInArrow(run, "dim int, n int, ids binary, rows binary, cells binary")


def _rest_norms(cells: np.ndarray, at: list[int]) -> np.ndarray:
    """Norms of the components from each place on, rounded up."""
    square = np.concatenate([np.cumsum((cells**2)[::-1], axis=0)[::-1], np.zeros((1, cells.shape[1]))])
    return np.sqrt(square[at]) * (1 + 1e-9) + 1e-9


class Best:
    """The best ``k`` candidates of each query of a block, so far."""

    def __init__(self, n: int, k: int):
        self.score = [np.zeros(0, object) for _ in range(n)]
        self.vec = [np.zeros(0, np.int64) for _ in range(n)]
        self.row = [np.zeros(0, np.int64) for _ in range(n)]
        self.k = k

    def floor(self, i: int):
        return self.score[i][-1] if len(self.score[i]) == self.k else None

    def add(self, i: int, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        s, v, r = np.concatenate([self.score[i], score]), np.concatenate([self.vec[i], vec]), np.concatenate([self.row[i], row])
        top = np.lexsort((r, v, -s))[: self.k]
        self.score[i], self.vec[i], self.row[i] = s[top], v[top], r[top]


def search_block(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, best: Best) -> int:
    """Merge one candidate block into ``best``; returns how many products were computed.

    ``q`` and ``c`` hold one column per vector.
    """
    dim, n = c.shape
    exact = object not in (q.dtype, c.dtype) and float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dim) < 2**52
    if not exact:
        q, c = _big(q), _big(c)
    cuts = [*range(0, dim, STEP), dim] if dim else [0, 0]
    q_rest, c_rest = (_rest_norms(q, cuts), _rest_norms(c, cuts)) if exact else (None, None)
    work = 0
    for i in range(q.shape[1]):
        live, total = np.flatnonzero(c_rows != q_rows[i]), 0
        for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            total = q[lo:hi, i] @ c[lo:hi, live] + total
            work += len(live) * (hi - lo)
            if best.floor(i) is None and hi < dim and len(live) > 4 * best.k:
                # a first bound: the full scores of those that lead so far
                lead = np.argpartition(total, len(live) - 4 * best.k)[-4 * best.k :]
                some = live[lead]
                best.add(i, total[lead] + q[hi:, i] @ c[hi:, some], c_ids[some], c_rows[some])
                work += len(some) * (dim - hi)
                live, total = np.delete(live, lead), np.delete(total, lead)
            if exact and hi < dim and (floor := best.floor(i)) is not None:
                keep = total + q_rest[s + 1, i] * c_rest[s + 1, live] >= floor
                live, total = live[keep], total[keep]
        if (floor := best.floor(i)) is not None:
            keep = total >= floor
            live, total = live[keep], total[keep]
        if len(live):
            best.add(i, total, c_ids[live], c_rows[live])
    return work


def _big(cells: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in cells], object).reshape(cells.shape)


def _joined(queries: DataFrame, candidates: DataFrame, k: int, lanes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, best = None, None, None, None

        def flush() -> pa.RecordBatch:
            n = [len(x) for x in best.score]
            score = [max(-(2**63), min(2**63 - 1, int(x))) for x in np.concatenate(best.score)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, n)),
                    pa.array(np.repeat(rows, n)),
                    pa.array(np.concatenate(best.vec), pa.int64()),
                    pa.array(np.concatenate(best.row), pa.int64()),
                    pa.array(score, pa.int64()),
                ],
                ["query_id", "query_row", "vec_id", "vec_row", "score"],
            )

        for b in batches:
            for r in range(b.num_rows):
                dim, qn, qi, qr, qc, cn, ci, cr, cc = (b.column(j)[r].as_py() for j in range(9))
                if qr != now:
                    if best is not None:
                        yield flush()
                    now, ids, rows, best = qr, np.frombuffer(qi, "<i8"), np.frombuffer(qr, "<i8"), Best(qn, k)
                search_block(
                    _integers(np.frombuffer(qc, "<f8").reshape(dim, qn)), rows, _integers(np.frombuffer(cc, "<f8").reshape(dim, cn)),
                    np.frombuffer(ci, "<i8"), np.frombuffer(cr, "<i8"), best,
                )
        if best is not None:
            yield flush()

    lane = F.pmod(F.xxhash64("rows"), F.lit(lanes))
    q = queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))))
    c = candidates.withColumn("lane", lane)
    both = q.alias("q").join(c.alias("c"), ["dim", "lane"])
    picked = both.select("dim", "q.n", "q.ids", "q.rows", "q.cells", "c.n", "c.ids", "c.rows", "c.cells")
    return picked.toDF(*[f"c{i}" for i in range(9)]).mapInArrow(run, "query_id bigint, query_row bigint, vec_id bigint, vec_row bigint, score bigint")


def search(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows for each row whose id divides by ``every``."""
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = embeddings.where(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    rows = cut(embeddings.sparkSession, rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lanes = max(LANES, -(-rows.count() // (BLOCK * BLOCKS_A_LANE)))
    found = _joined(_blocks(rows.where(F.col("vec_id") % every == 0), QUERY_BLOCK), _blocks(rows, BLOCK), k, lanes)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % {QUERY_EVERY} = 0
) WHERE rank <= {K}
"""
