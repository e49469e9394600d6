"""Near-duplicate embeddings by product quantisation, with exact results.

Equal vectors are one class first, however many rows hold them. A sample of the classes fits the
index: coarse centroids (k-means), and for the residuals a codebook per subspace. Every class is
then assigned to the inverted list of its nearest centroid and stored with its residual's codes and
the length of what the codes leave out.

A link needs two unit vectors within ``reach`` = sqrt(2 - 2 * cosine) of each other. What is looked
at is bounded by that distance alone, so no link is lost:

- probes: a list is left out for a vector only if the vector is further than ``reach`` from the
  plane between the two centroids, or from the ball that holds the list;
- codes: the distance to a coded vector is summed from a table per subspace (asymmetric: the query
  is not coded); a candidate leaves only if that distance less its coding error exceeds ``reach``;
- the rest is reranked by the cosine in double precision of the vectors themselves.

Lists are cut into blocks of about ``BLOCK`` vectors, small lists share one. Pairs of blocks meet
through joins on block numbers; a task holds one pair. It reports, per vector, the number of
its links and the component it is in within the pair, never the links one by one.

The model (at most ``LISTS`` centroids and 256 words a subspace) is the only thing sent to all
tasks, and the sample it is fitted on the only thing collected: ``PER_LIST`` vectors a list, so at
most 2 * 32 * 1024. Vectors that it fits badly cost time, not links.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component, and
rows with a null ``vec_id``, link with nothing (0 links, their own id, kept); vectors of different
lengths have no cosine; equal vectors link with each other; a repeated row is another vector (so
rows of one id may differ, and copies with the component's smallest id are all kept); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut

COSINE = 0.95
LISTS = 1024  # coarse centroids, at most
PER_LIST = 32  # sampled vectors a centroid
SUBSPACE = 8  # dimensions a code stands for
WORDS = 256  # codewords a subspace
BLOCK = 4096
STEP = 256  # queries of a block whose tables are held together
TILE = 1024  # candidates that are summed up for them together
SINGLE = 1e-4  # far above the rounding errors of table sums in single precision
ROUNDS = 8  # of k-means
MARGIN = 1e-6  # added to distances: far above their rounding errors


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that no square overflows; cosines stay the same bits."""
    _, e = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    return np.ldexp(v, -e[:, None])


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled rows, filled with zeros up to ``dim``, and their lengths."""
    off, flat = np.asarray(column.offsets), np.asarray(column.values, np.float64)
    n = np.diff(off)
    out = np.zeros((len(n), dim))
    inside = np.arange(dim) < n[:, None]
    out[inside] = flat[off[0] : off[-1]]
    return _scaled(out), n.astype(np.int32)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=1))[:, None]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)


def k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = rows[np.sort(r.choice(len(rows), min(k, len(rows)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = _squares(rows, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Model:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        unit = _unit(sample)
        self.centres = k_means(unit, lists, 1)
        rest = unit - self.centres[_squares(unit, self.centres).argmin(axis=1)]
        parts = self._parts(rest)
        words = [k_means(parts[:, m], WORDS, 2 + m) for m in range(parts.shape[1])]
        self.words = np.stack(words)  # subspace, word, dimension

    @staticmethod
    def _parts(v: np.ndarray) -> np.ndarray:
        m = -(-v.shape[1] // SUBSPACE)
        out = np.zeros((len(v), m * SUBSPACE))
        out[:, : v.shape[1]] = v
        return out.reshape(len(v), m, SUBSPACE)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, squared length of the coded vector, its distance from the vector, and the
        vector's distance from its centroid."""
        near = _squares(unit, self.centres)
        lists = near.argmin(axis=1)
        parts = self._parts(unit - self.centres[lists])
        codes = np.stack([_squares(parts[:, m], self.words[m]).argmin(axis=1) for m in range(parts.shape[1])], axis=1)
        coded = self.centres[lists] + self._decode(codes)[:, : unit.shape[1]]
        away = np.sqrt(((unit - self.centres[lists]) ** 2).sum(axis=1))
        return lists, codes, (coded**2).sum(axis=1), np.sqrt(((unit - coded) ** 2).sum(axis=1)), away

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Products of each vector's parts with the codewords: vector, subspace * word."""
        products = np.einsum("nmd,mwd->nmw", self._parts(unit), self.words)
        return products.reshape(len(unit), -1)

    def probes(self, unit: np.ndarray, own: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
        """Whether each list can hold a vector within ``reach``."""
        d = _squares(unit, self.centres)
        apart = np.sqrt(_squares(self.centres, self.centres))[own]
        plane = d - d[np.arange(len(d)), own][:, None] <= 2 * apart * reach + MARGIN
        return plane & (np.sqrt(d) <= radii + reach)


def reach_of(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + MARGIN


class Block:
    """Vectors of a block with their codes, as columns of one row."""

    FIELDS = (("cid", "<i8"), ("size", "<i8"), ("length", "<i4"), ("list", "<i4"), ("square", "<f8"), ("error", "<f8"), ("codes", "u1"), ("vec", "<f8"))
    SQL = "block int, " + ", ".join(f"{f} binary" for f, _ in FIELDS)

    def __init__(self, cells: list[bytes]):
        for (name, kind), cell in zip(self.FIELDS, cells, strict=True):
            setattr(self, name, np.frombuffer(cell, kind))
        n = len(self.cid)
        self.codes, self.vec = self.codes.reshape(n, -1), self.vec.reshape(n, -1)

    @property
    def words(self) -> int:
        return self.codes.shape[1]

    @staticmethod
    def pack(columns: dict[str, np.ndarray]) -> list[bytes]:
        return [np.ascontiguousarray(columns[name]).astype(kind).tobytes() for name, kind in Block.FIELDS]


def _join(mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the components of the links ``a``, ``b`` one mark each; marks are members' places."""
    while ((x := mark[a]) != (y := mark[b])).any():
        np.minimum.at(mark, np.maximum(x, y), np.minimum(x, y))
        while ((up := mark[mark]) != mark).any():
            mark[:] = up


def meet(q: Block, c: Block, same: bool, model: Model, radii: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Link counts and component marks of the vectors of two blocks (of one block with itself if
    ``same``), and how many pairs were reranked. Marks number the vectors of both blocks in turn.

    ``STEP`` queries meet ``TILE`` candidates at a time: a code picks a row of a table, which holds
    the products of its codeword with all these queries.
    """
    nq, nc = len(q.cid), len(c.cid)
    reach = reach_of(cosine)
    mark = np.arange(nq if same else nq + nc)
    links_q, links_c = np.zeros(nq, np.int64), np.zeros(nc, np.int64)
    norm_q, norm_c = (np.sqrt((b.vec**2).sum(axis=1)) for b in (q, c))
    unit = q.vec / norm_q[:, None]
    far = (reach + c.error) ** 2 - 1 - c.square + MARGIN  # a query's unit length is taken out
    least = (-far / 2 - SINGLE).astype(np.float32)[:, None]  # product of a candidate that stays
    shift, reranked = 0 if same else nq, 0
    by_list = np.argsort(c.list, kind="stable")  # a tile's candidates are of few lists
    for lo in range(0, nq, STEP):
        part = unit[lo : lo + STEP]
        open_ = np.ascontiguousarray(model.probes(part, q.list[lo : lo + STEP], radii, reach).T)
        live = by_list[open_.any(axis=1)[c.list[by_list]]]
        if same:
            live = live[live > lo]
        if not len(live):
            continue
        tables = model.tables(part).reshape(len(part), c.words, -1).transpose(1, 2, 0).astype(np.float32, order="C")
        centre = (model.centres @ part.T).astype(np.float32)
        for at in range(0, len(live), TILE):
            some = live[at : at + TILE]
            product = centre[c.list[some]]
            for m in range(c.words):
                product += tables[m][c.codes[some, m]]
            j, i = np.nonzero((product >= least[some]) & open_[c.list[some]])
            if same:
                later = some[j] > lo + i
                j, i = j[later], i[later]
            reranked += len(j)
            if not len(j):
                continue
            (rows, j_at), (columns, i_at) = np.unique(j, return_inverse=True), np.unique(i, return_inverse=True)
            dots = c.vec[some[rows]] @ q.vec[lo + columns].T
            a, b = lo + i, some[j]
            hit = (dots[j_at, i_at] / (norm_c[b] * norm_q[a]) >= cosine) & (c.length[b] == q.length[a])
            a, b = a[hit], b[hit]
            np.add.at(links_q, a, c.size[b])
            np.add.at(links_c, b, q.size[a])
            _join(mark, a, shift + b)
    return (links_q + links_c if same else links_q), links_c, mark, reranked


def _layout(counts: dict[int, int], lists: int, block: int) -> tuple[list[int], list[int]]:
    """First block and number of blocks of each list; small lists in turn share a block."""
    first, many, at, room = [0] * lists, [0] * lists, 0, block
    for k in range(lists):
        n = counts.get(k, 0)
        if n > block:
            at += room < block
            first[k], many[k] = at, -(-n // block)
            at, room = at + many[k], block
        elif n:
            if n > room:
                at, room = at + 1, block
            first[k], many[k], room = at, 1, room - n
    return first, many


def _index(classes: DataFrame, model: Model, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, length = _vectors(b.column(2), dim)
            lists, codes, square, error, away = model.encode(_unit(vec))
            columns = [
                b.column(0), b.column(1), pa.array(length), pa.array(lists.astype(np.int32)), pa.array(square), pa.array(error), pa.array(away),
                pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array([r.tobytes() for r in vec], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "size", "length", "list", "square", "error", "away", "codes", "vec"])

    sql = "cid bigint, size bigint, length int, list int, square double, error double, away double, codes binary, vec binary"
    return classes.select("cid", "size", "embedding").mapInArrow(run, sql)


def _blocks(index: DataFrame, first: list[int], many: list[int], model: Model, radii: np.ndarray, reach: float) -> DataFrame:
    """One row per block: its vectors, and the lists that any of them has to probe."""
    of_list = F.col("list") + 1
    spread = F.pmod(F.xxhash64("vec"), F.element_at(F.lit(many), of_list).cast("bigint"))
    rows = index.withColumn("block", (F.element_at(F.lit(first), of_list) + spread).cast("int"))
    names = [f for f, _ in Block.FIELDS]

    def pack(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        columns = {k: t[k].to_numpy() for k in ("cid", "size", "length", "list", "square", "error")}
        columns["codes"] = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8)
        columns["vec"] = np.frombuffer(b"".join(t["vec"].to_pylist()), np.float64)
        unit = _unit(columns["vec"].reshape(t.num_rows, -1))
        wanted = np.zeros(len(radii), bool)
        for lo in range(0, len(unit), STEP):
            wanted |= model.probes(unit[lo : lo + STEP], columns["list"][lo : lo + STEP], radii, reach).any(axis=0)
        cells = [pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in Block.pack(columns))]
        return pa.RecordBatch.from_arrays([*cells, pa.array([np.flatnonzero(wanted).tolist()], pa.list_(pa.int32()))], ["block", *names, "probes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo and at[lo] != now:
                    if parts:
                        yield pack(now, parts)
                    now, parts = int(at[lo]), []
                if hi > lo:
                    parts.append(b.slice(lo, hi - lo))
        if parts:
            yield pack(now, parts)

    dealt = rows.select(*names, "block").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, f"{Block.SQL}, probes array<int>")


def _meetings(blocks: DataFrame, first: list[int], many: list[int], model: Model, radii: np.ndarray, cosine: float) -> DataFrame:
    """cid, links, mark of every vector that has a link in a pair of blocks."""
    names = [f for f, _ in Block.FIELDS]
    list_ = F.col("list") + 1
    lo, n = F.element_at(F.lit(first), list_), F.element_at(F.lit(many), list_)
    probes = blocks.select("block", F.explode("probes").alias("list")).where(n > 0)
    pairs = probes.select(F.col("block").alias("q"), F.explode(F.sequence(lo, lo + n - 1)).alias("c")).where("q <= c").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cells = [b.column(j)[r].as_py() for j in range(2 + 2 * len(names))]
                same = cells[0] == cells[1]
                q, c = Block(cells[2 : 2 + len(names)]), Block(cells[2 + len(names) :])
                links_q, links_c, mark, _ = meet(q, c, same, model, radii, cosine)
                cid = q.cid if same else np.concatenate([q.cid, c.cid])
                links = links_q if same else np.concatenate([links_q, links_c])
                has = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(cid[has]), pa.array(links[has]), pa.array(cid[mark][has])], ["cid", "links", "mark"])

    def side(prefix: str) -> DataFrame:
        return blocks.select(F.col("block").alias(prefix), *[F.col(f).alias(f"{prefix}_{f}") for f in names])

    both = pairs.join(side("c"), "c").join(side("q"), "q")
    picked = both.select("q", "c", *[f"q_{f}" for f in names], *[f"c_{f}" for f in names])
    return picked.mapInArrow(run, "cid bigint, links bigint, mark bigint")


def _sound(vec_id, v):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec_id.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, lists: int | None = None, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    ``lists`` is the number of coarse centroids: by default a power of two of about the square root
    of the number of different vectors, at most ``LISTS``.
    """
    spark = embeddings.sparkSession
    block = block or BLOCK
    vec_id = F.col("vec_id").cast("bigint")
    rows = embeddings.select(vec_id.alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = _sound(F.col("vec_id"), F.col("embedding"))
    classes = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    classes = cut(spark, classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    lists = lists or min(LISTS, 2 ** round(math.log2(math.sqrt(n))))
    want = max(PER_LIST * lists, WORDS)
    # by hash of the vector: the same sample whatever the partitions
    chosen = classes if want >= n else classes.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(want / n * (1 << 30)))
    sample = chosen.select("embedding").limit(2 * want).toArrow()["embedding"].combine_chunks()
    if not len(sample):
        sample = classes.select("embedding").limit(1).toArrow()["embedding"].combine_chunks()
    model = Model(_vectors(sample, dim)[0], lists)
    index = cut(spark, _index(classes, model, dim), "index")
    found = {r.list: r for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    k = len(model.centres)
    radii = np.array([found[i].away + MARGIN if i in found else -np.inf for i in range(k)])
    first, many = _layout({i: r.n for i, r in found.items()}, k, block)
    blocks = cut(spark, _blocks(index, first, many, model, radii, reach_of(cosine)), "blocks")
    met = cut(spark, _meetings(blocks, first, many, model, radii, cosine), "links")
    labels = components(met.select(F.col("cid").alias("a"), F.col("mark").alias("b")))
    per_class = (
        classes.join(met.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
        .join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        .select("cid", "first", "embedding", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "cid").alias("label"))
    )
    lowest = per_class.groupBy("label").agg(F.min("first").alias("component_id"))
    answer = per_class.join(lowest, "label").select("embedding", "n_links", "component_id")
    linked = rows.where(sound).join(answer, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionAll(alone)


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {COSINE}
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.y FROM reach JOIN links ON reach.r = links.x
), least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""
