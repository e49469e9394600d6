"""Near duplicates: n-gram Jaccard join by rare-first prefix filtering.

Rows with the same set of word shingles form one class. The shingles of a class are put in one
global order, rare ones first. Every shingle is counted, once for each class of a group of texts, in a
table of ``SKETCH`` cells by its hash; a shingle's place is that of its cell by count, then its
hash. So a passage spread one per group over many groups comes late. Those that classes of one
group share also have counts of their own, and the ``FREQUENT`` largest of these come last of
all. (Any global order gives the same links; only work depends on it.) Two sets of Jaccard
similarity ``percent`` / 100 share a shingle in their first n - ceil(percent * n / 100) + 1
places, so classes are joined on those prefix shingles.

A list of classes that share a prefix shingle is joined in steps, as only connection counts.
First each member of a list of three or more is paired with one member. What is verified as a link is
contracted to components; lists whose members all are in one component are done. After
``HEADS`` such steps, all pairs of members from different components are joined in the lists
that remain, thinned by the length filter, the positional filter (which asks for up to
``SHARED`` common shingles in the right places) and the suffix filter: the parities of the
shingles' hash cells differ in no more cells than the sets differ in shingles. Each pair is
verified once, by intersecting the full sets. So no pair between different components is left
out, and a large group of near copies costs rows in proportion to its size.

For a prefix shingle that many of a group of texts have, the task sends one row; the members
are listed beside the shuffle. So a shingle that a third of all rows share has as many rows in it
as there are such groups, not as there are texts.

Defined results: null, empty and wordless texts have no shingles, link with nothing and are
their own component; repeated rows are one class; rows of one doc_id with different texts are
different members; a null doc_id never is a component's smallest id (the id is null where no
other is there). Other columns are ignored. Shingles and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, in_table
from .components import components
from .storage import cut
from .text import LOWER, NON_SPACE, U64, hash_words, mix, string_chunks, window_hashes, words

GRAM = 5
PERCENT = 80
FREQUENT = 1 << 17  # entries of the table of frequent shingles: 1 MB, whatever the corpus
SKETCH = 1 << 18  # cells in which all shingles are counted: 2 MB, whatever the corpus
COUNTED = 3_000_000  # shingles of a group of texts that are counted together in a task
CROWD = 3  # members from which a group of texts sends one row for a shingle, and a list has rounds
HEADS = (1, 3)  # rounds of pairing each list with one member, by one of 2, then of 4 hashes
SHARED = 3  # shingles that the prefixes of a pair must share, where they are long enough
CELLS = 512  # parity bits of the suffix filter
PARITY = [f"p{k}" for k in range(CELLS // 64)]
CROWD_LEAD = 1 << 31  # bit of ``np`` of a row that stands for a crowd
_TOP = U64(1 << 63)
_LOW_BITS = U64(64 - (SKETCH.bit_length() - 1))
_LOW = (U64(1) << _LOW_BITS) - U64(1)


def shingle_sets(column: pa.Array, gram: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Row range, sorted distinct shingle hashes of each row, and each row's class hash."""
    for lo, hi, data, off in string_chunks(column):
        low = LOWER[data]
        starts, ends, first = words(low, off, NON_SPACE)
        h = hash_words(low, starts, ends)
        full = window_hashes(h, gram)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= gram:
                sets.append(np.unique(full[a : b - gram + 1]))
            else:
                sets.append(window_hashes(h[a:b], b - a) if b > a else np.zeros(0, U64))
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, U64)])
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(flat), dtype=U64)])
        ends = np.cumsum(sizes)
        yield lo, hi, sets, mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64))


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> _LOW_BITS).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _profiles(docs: DataFrame, gram: int) -> DataFrame:
    """doc_id, text key, set size, class and parity words of every row; and rows without these:
    the shingles that more than one class of a group of texts has with their counts, and a
    task's counts of all shingles by cell."""
    names = ["doc_id", "tk", "n", "sig", *PARITY, "hot", "times", "cells"]
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        cells = np.zeros(SKETCH, np.int64)
        none = [pa.nulls(1, pa.int64())] * (4 + len(PARITY))

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate([*held.values()]), return_counts=True)
            cells[:] += np.bincount(np.repeat(_cell(found), times), minlength=SKETCH)
            often = times > 1
            shared = [pa.array([found[often].view(np.int64)], lists), pa.array([times[often]], lists)]
            return pa.RecordBatch.from_arrays([*none, *shared, pa.nulls(1, lists)], names)

        for b in batches:
            for lo, hi, sets, sig in shingle_sets(b.column(2), gram):
                sizes = np.array([len(s) for s in sets], np.int64)
                cell = (np.concatenate(sets) >> U64(64 - (CELLS.bit_length() - 1))).astype(np.int64)
                own = np.repeat(np.arange(hi - lo), sizes)
                odd = np.bincount(own * CELLS + cell, minlength=(hi - lo) * CELLS).reshape(hi - lo, CELLS) & 1
                parity = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                known = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(sizes), _signed(sig)]
                blank = [pa.nulls(hi - lo, lists)] * 3
                yield pa.RecordBatch.from_arrays([*known, *[pa.array(parity[:, k]) for k in range(len(PARITY))], *blank], names)
                for s, c in zip(sets, sig.tolist(), strict=True):
                    if c not in held:
                        held[c] = s
                        total += len(s)
                if total > COUNTED:
                    yield counted()
                    held, total = {}, 0
        if held:
            yield counted()
        if cells.any():
            yield pa.RecordBatch.from_arrays([*none, *[pa.nulls(1, lists)] * 2, pa.array([cells], lists)], names)

    kinds = [f"{n} bigint" for n in names[:-3]] + [f"{n} array<bigint>" for n in names[-3:]]
    return docs.mapInArrow(run, ", ".join(kinds))


def _frequent(profiles: DataFrame) -> np.ndarray:
    """The most frequent shingles, most frequent last: at most ``FREQUENT`` of them."""
    pairs = profiles.where("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "times")).alias("x"))
    count = pairs.groupBy(F.col("x.hot").alias("h")).agg(F.sum("x.times").alias("c"))
    top = count.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    return top["h"].to_numpy()[::-1].copy().view(U64)


def _cell_order(profiles: DataFrame) -> np.ndarray:
    """Place of each cell by its count over all texts, rare ones first."""
    cells = profiles.where("cells IS NOT NULL").select(F.posexplode("cells").alias("cell", "c"))
    count = cells.groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(SKETCH, np.int64)
    total[count["cell"].to_numpy()] = count["c"].to_numpy()
    place = np.empty(SKETCH, np.uint32)
    place[np.argsort(total, kind="stable")] = np.arange(SKETCH)
    return place


def _prefix_rows(docs: DataFrame, frequent: np.ndarray, cells: np.ndarray, gram: int, percent: int) -> DataFrame:
    """Rows of prefix shingles: key (the shingle), sig, np (set size and place in the prefix).
    Where ``CROWD`` or more classes of a group of texts have a shingle, one of them has a row
    and all of them are listed in ``more`` (one further row per group of texts)."""
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(U64) + _TOP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, sets, sig in shingle_sets(b.column(0), gram):
                size = np.array([len(s) for s in sets], np.int64)
                _, one = np.unique(sig, return_index=True)
                one = one[size[one] > 0]
                one = one[np.lexsort((sig[one].view(np.int64), size[one]))]
                parts, places = [], []
                for i in one.tolist():
                    s = sets[i]
                    token = (cells[_cell(s)].astype(U64) << _LOW_BITS | s & _LOW) >> U64(1)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        token = np.where(known[at] == s, rank[at], token)
                    token.sort()
                    keep = len(s) - (percent * len(s) + 99) // 100 + 1
                    parts.append(token[:keep])
                    places.append(np.arange(min(keep, len(s))))
                if not parts:
                    continue
                n = np.array([len(p) for p in parts], np.int64)
                token, place, own = np.concatenate(parts), np.concatenate(places), np.repeat(one, n)
                np_ = (size[own] << 32) | place
                by = np.argsort(token, kind="stable")
                start = np.flatnonzero(np.concatenate([[True], token[by][1:] != token[by][:-1]]))
                count = np.diff(np.concatenate([start, [len(token)]]))
                many = np.repeat(count >= CROWD, count)
                lead = np.zeros(len(token), bool)
                lead[by[start]] = True
                crowd = np.zeros(len(token), bool)
                crowd[by[many]] = True
                flag = np.where(lead & crowd, CROWD_LEAD, 0)
                row = np.flatnonzero(lead | ~crowd)  # in document order: a document's rows lie together
                inside = by[many]
                more = pa.StructArray.from_arrays([_signed(token[inside]), _signed(sig[own[inside]]), pa.array(np_[inside])], ["tok", "sig", "np"])
                extra = min(1, len(inside))  # one more row carries `more`, under a key of its own
                ends = pa.array(np.concatenate([np.zeros(len(row) + 1, np.int32), [len(more)] * extra]).astype(np.int32))
                plain = pa.array(np.arange(len(row) + extra) < len(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate([token[row], mix(token[:extra] ^ sig[own[:extra]])])),
                        _signed(np.concatenate([sig[own[row]], sig[own[:extra]]])),
                        pa.array(np.concatenate([(np_ | flag)[row], np.zeros(extra, np.int64)])),
                        pa.ListArray.from_arrays(ends, more, mask=plain),
                    ],
                    ["key", "sig", "np", "more"],
                )

    one = "array<struct<tok:bigint,sig:bigint,np:bigint>>"
    return docs.select("text").mapInArrow(run, f"key bigint, sig bigint, np bigint, more {one}")


def _shared_prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(tok, sig, np) of all classes in lists of more than one class. A list of two stays only
    if its one pair passes the length and positional filters (and neither stands for a crowd)."""
    w = Window.partitionBy("key").orderBy("np", "sig")
    near = {f"{f}{k}": getattr(F, f)(F.struct("sig", "np"), k).over(w) for f in ("lag", "lead") for k in (1, 2)}
    seen = rows.select("key", "sig", "np", "more", *[c.alias(n) for n, c in near.items()])
    seen = seen.withColumns({f"{n}_np": F.col(f"{n}.np") for n in ("lag1", "lead1")})
    def may(other: str) -> Column:
        crowd = F.col("np").bitwiseOR(F.col(other)).bitwiseAND(CROWD_LEAD) != 0
        return crowd | _placed("np", other, percent)

    one_other = F.when(F.col("lag1").isNull() & F.col("lead2").isNull(), may("lead1_np")).when(
        F.col("lead1").isNull() & F.col("lag2").isNull(), may("lag1_np")
    )
    apart = F.coalesce(F.col("lag1.sig") != F.col("sig"), F.lit(False)) | F.coalesce(F.col("lead1.sig") != F.col("sig"), F.lit(False))
    listed = seen.where(F.col("more").isNull() & apart & F.coalesce(one_other, F.lit(True)))
    inside = rows.where(F.col("more").isNotNull()).select(F.explode("more").alias("x")).select("x.*")
    plain = F.col("np").bitwiseAND(~CROWD_LEAD).alias("np")
    return listed.select(F.col("key").alias("tok"), "sig", plain).unionByName(inside).dropDuplicates(["tok", "sig"])


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length filter and suffix filter on two aliased rows of (n, parity words)."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (differ * (100 + percent) <= (nx + ny) * (100 - percent))


def _size(np_: str) -> Column:
    return F.shiftright(np_, 32)


def _place(np_: str) -> Column:
    return F.col(np_).bitwiseAND(CROWD_LEAD - 1)


def _overlap(nx: Column, ny: Column, percent: int) -> Column:
    """The least overlap of two sets that are similar enough."""
    return F.ceil((nx + ny) * percent / (100 + percent))


def _common(nx: Column, ny: Column, percent: int) -> Column:
    """Shingles that a pair must share in its prefixes: up to ``SHARED``, as long as both
    prefixes are that long. (Prefixes of n - overlap + k places share k shingles at least.)"""
    reach = [_overlap(nx, ny, percent) - F.ceil(n * percent / 100) + 1 for n in (nx, ny)]
    return F.least(F.lit(SHARED).cast("bigint"), *reach)


def _placed(x: str, y: str, percent: int) -> Column:
    """Length filter and positional filter on two ``np`` columns: whether a common shingle lies
    in the parts of both prefixes where ``_common`` of them must be."""
    nx, ny = _size(x), _size(y)
    rest = F.least(nx - _place(x), ny - _place(y))
    near = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    return near & (rest > _overlap(nx, ny, percent) - _common(nx, ny, percent))


def _counted(met: DataFrame, x: Column, y: Column, x_np: str, y_np: str, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows of ``met`` with as many rows as they must share shingles."""
    need = _common(_size(x_np), _size(y_np), percent)
    rows = met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), need.alias("need"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")


def _thinned(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the length and suffix filters leave."""
    x, y = light.alias("x"), light.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.sig")).join(y, (F.col("b") == F.col("y.sig")) & _may_link("x", "y", percent))
    return both.select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The sets of the classes in ``pairs``
    are made again from the texts; a bit table keeps the others out of the shuffle, which both
    joins below share."""
    spark = docs.sparkSession
    wanted = cut(spark, pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "wanted")
    if wanted.isEmpty():
        return pairs
    table = bit_table(wanted, "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, sets, sig in shingle_sets(b.column(0), gram):
                _, one = np.unique(sig, return_index=True)
                one = one[in_table(table, sig[one])]
                rows = pa.array([sets[i].view(np.int64) for i in one], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([_signed(sig[one]), rows], ["sig", "shingles"])

    made = docs.select("text").mapInArrow(run, "sig bigint, shingles array<bigint>").join(wanted, "sig", "left_semi")
    sets = made.dropDuplicates(["sig"])
    x, y = sets.alias("x"), sets.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.sig")).join(y, F.col("b") == F.col("y.sig"))
    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    total = F.size("x.shingles") + F.size("y.shingles")
    return both.where(common * (100 + percent) >= total * percent).select("a", "b")


def _contracted(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, label) after more links: components of the links between the groups so far."""
    spark = links.sparkSession
    if groups is None:
        return cut(spark, components(links), "groups")
    of = groups.select("node", "label")
    bridges = (
        links.join(of.alias("p"), F.col("a") == F.col("p.node"), "left")
        .join(of.alias("q"), F.col("b") == F.col("q.node"), "left")
        .select(F.coalesce("p.label", "a").alias("a"), F.coalesce("q.label", "b").alias("b"))
    )
    merged = components(bridges).select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = of.join(merged, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    # nodes that were alone until now
    fresh = merged.join(of, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return cut(spark, moved.unionByName(fresh), "groups")


def null_first_id(doc_id: Column) -> Column:
    """The id as a key that is never null; a null counts as the smallest id."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(-(2**63)))


def keep_one(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one of each component (that of the smallest id);
    rows without words all stay. Repeated rows are reduced to one within the tasks that read them
    before they meet, so one row that is a third of the table is a few rows a task."""
    found = near_duplicates(docs, gram, percent).where("n_shingles > 0").withColumn("id0", null_first_id(F.col("doc_id")))
    kept = found.groupBy("component").agg(F.min(F.struct("id0", "tk")).alias("x")).select("x.*")
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = [null_first_id(F.col("doc_id")).alias("id0"), F.xxhash64("text").alias("tk"), "*"]
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = docs.where(has_words).select(*key).toDF("id0", "tk", *names).dropDuplicates(["id0", "tk"])
    rows = once.join(kept, ["id0", "tk"]).select(*names)
    return rows.unionAll(docs.where(~has_words).toDF(*names)).toDF(*docs.columns)


def near_duplicates(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; then ``tk`` (hash of the text) and
    ``component`` (a class of the component, null without shingles)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    stored = cut(spark, _profiles(keyed, gram), "profiles")
    frequent, cells = _frequent(stored), _cell_order(stored)
    profiles = stored.where("n IS NOT NULL")
    light = profiles.where("n > 0").select("sig", "n", *PARITY).dropDuplicates(["sig"])
    shared = cut(spark, _shared_prefixes(_prefix_rows(keyed, frequent, cells, gram, percent), percent), "prefixes")

    lists, groups, done = shared.withColumn("label", F.col("sig")), None, None
    for turn in range(len(HEADS) + 1):
        if turn < len(HEADS):
            # each member with one of its list; the lists of a family choose among few
            choice = F.min_by(F.struct("sig", "np", "label"), F.xxhash64("sig", F.col("tok").bitwiseAND(HEADS[turn]), F.lit(turn)))
            size = F.count("*").alias("members")
            heads = lists.groupBy("tok").agg(choice.alias("h"), size).where(F.col("members") >= CROWD)
            heads = heads.select("tok", "h.*").toDF("tok", "h_sig", "h_np", "h_label")
            met = lists.join(heads, "tok").where((F.col("label") != F.col("h_label")) & _placed("np", "h_np", percent))
            pairs = met.select(F.least("sig", "h_sig").alias("a"), F.greatest("sig", "h_sig").alias("b")).distinct()
            pairs = _thinned(pairs, light, percent)
        else:
            # everything that is still apart
            left = cut(spark, lists.join(light, "sig"), "open")
            x, y = left.alias("x"), left.alias("y")
            apart = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.label") < F.col("y.label"))
            met = x.join(y, apart & _may_link("x", "y", percent) & _placed("x.np", "y.np", percent))
            pairs = _counted(met, F.col("x.sig"), F.col("y.sig"), "x.np", "y.np", percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = cut(spark, pairs, "pairs")
        groups = _contracted(_verified(keyed, pairs, gram, percent), groups)
        if turn < len(HEADS):
            done = pairs if done is None else done.unionByName(pairs)
            labelled = shared.join(groups, shared["sig"] == groups["node"], "left")
            labelled = labelled.select("tok", "sig", "np", F.coalesce("label", "sig").alias("label"))
            mixed = labelled.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
            lists = cut(spark, labelled.join(mixed.select("tok"), "tok", "left_semi"), "lists")

    classes = profiles.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("low"))
    member = classes.join(groups, classes["sig"] == groups["node"], "left").select(
        "sig", "low", F.coalesce("label", "sig").alias("component")
    )
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = member.where("sig IS NOT NULL").join(lowest, "component").select("sig", "component_id", "component")
    empty = profiles.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "tk", F.lit(None).cast("bigint").alias("component"))
    out = profiles.where("n > 0").join(of_class, "sig").select("doc_id", "n", "component_id", "tk", "component").unionByName(empty)
    return out.withColumnRenamed("n", "n_shingles")
