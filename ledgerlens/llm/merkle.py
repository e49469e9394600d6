"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and every row's
proof, by butterfly exchange.

The rows of a group stand in order and are cut into aligned blocks of ``fanout ** levels`` leaves.
A block hashes its own subtree; then blocks swap their subtree roots round by round: in round r,
the ``fanout`` blocks whose numbers differ only in digit r (to the base ``fanout``) meet, each
keeps the others' roots as the siblings of its next level, and each hashes the common parent
itself. After as many rounds as the largest group's block count has digits, every block holds its
group's root and all its upper siblings: hashes are computed more than once, and no pass goes down
again. Empty blocks fill a group up to a power of ``fanout``, so every meeting has the same few
rows, whatever the groups' sizes; an empty block has no digest and is nobody's sibling. The roots
of the groups are the leaves of a second tree, built the same way; its proofs (one row per group)
are joined to the blocks.

Only digests and ids are shuffled, never texts. Rows are numbered by ranges and counts per range,
so neither a group nor a repeated id goes through one task; a task of the later steps holds one block.

Defined results: a null value is hashed as ``-``; rows of one ``doc_id`` are ordered by their leaf,
a null ``doc_id`` comes first and counts as untampered; repeated rows are leaves of their own with
equal digests; a null ``lang`` is a group of its own, before all others (the empty string too is one);
a lone leaf is its group's root, and a lone group's root is the root; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

FANOUT = 2
LEVELS = 12  # levels of a block: 4,096 leaves at a fanout of 2
TAMPERED_EVERY = 7
ROUNDS_A_CUT = 4  # rounds planned together

Levels = list[list[str]]


def _field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values of one row."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in values]), 256))


def _rounds(n: int, fanout: int) -> int:
    """Levels of a tree over n nodes."""
    r = 0
    while n > 1:
        n, r = -(-n // fanout), r + 1
    return r


def parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def build(nodes: list[str], fanout: int, height: int) -> Levels:
    """All levels from ``nodes`` up to ``height`` levels above them."""
    levels = [nodes]
    for _ in range(height):
        last = levels[-1]
        levels.append([parent(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def siblings(levels: Levels, at: int, fanout: int) -> Levels:
    """The other nodes of each run on the way up from node ``at``, left to right."""
    out = []
    for level in levels[:-1]:
        lo = at - at % fanout
        out.append(level[lo:at] + level[at + 1 : lo + fanout])
        at //= fanout
    return out


def fold(node: str, at: int, proof: Levels, fanout: int) -> str:
    """The root that ``node`` at place ``at`` leads to with the siblings of ``proof``."""
    for others in proof:
        k = at % fanout
        node = parent([*others[:k], node, *others[k:]])
        at //= fanout
    return node


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a string ``grp``) and their place ``pos`` in the group of ``n`` rows."""
    keys = ["grp", *order, "row"]  # the row number lets equal rows spread over the ranges
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    stored = cut(rows.sparkSession, ranged.withColumn("part", F.spark_partition_id()), "leaves")
    counts = stored.groupBy("grp", "part").count()
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("grp", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), F.sum("count").over(group).alias("n"))
    within = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "row"))
    return stored.withColumn("nth", within).join(base, ["grp", "part"]).withColumn("pos", F.col("base") + F.col("nth") - 1)


def _blocks(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, block, n and the block's rows in order."""
    size = F.lit(fanout**levels).cast("bigint")
    block = F.call_function("div", F.col("pos"), size)
    packed = rows.groupBy("grp", block.alias("block")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "leaf", "item"))).alias("leaves")
    )
    return cut(rows.sparkSession, packed, "blocks")


def _block_height(n: int, fanout: int, levels: int) -> int:
    return levels if n > fanout**levels else _rounds(n, fanout)


def _block_roots(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, leaves = b.column(2).to_pylist(), b.column(3)
            roots = [build([x.hex() for x in leaves[i].as_py()], fanout, _block_height(n[i], fanout, levels))[-1][0] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(roots, pa.string())], ["grp", "block", "n", "node"])

    picked = blocks.select("grp", "block", "n", F.col("leaves.leaf"))
    return picked.mapInArrow(run, "grp string, block bigint, n bigint, node string")


def _butterfly(roots: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, block, top (the group's root) and up (siblings of each level above the blocks)."""
    size, f = F.lit(fanout**levels).cast("bigint"), F.lit(fanout).cast("bigint")
    many = F.call_function("div", F.col("n") + size - 1, size)
    # rounds of the group: the least r with fanout ** r >= its blocks
    state = cut(roots.sparkSession, roots.withColumn("blocks", many), "roots")
    most = state.agg(F.max("blocks")).first()[0] or 0
    rounds = _rounds(most, fanout)
    own = F.lit(0)
    for r in range(rounds):
        own = F.when(F.col("blocks") > fanout**r, r + 1).otherwise(own)
    no_up = F.array().cast("array<array<string>>")
    state = state.select("grp", "block", "blocks", own.alias("rounds"), "node", no_up.alias("up"))
    full = F.lit(1).cast("bigint")
    for r in range(rounds):
        full = F.when(F.col("rounds") > r, F.lit(fanout ** (r + 1)).cast("bigint")).otherwise(full)
    last = state.where((F.col("block") == F.col("blocks") - 1) & (F.col("blocks") < full))
    empty = last.select("grp", F.explode(F.sequence(F.col("blocks"), full - 1)).alias("block"), "blocks", "rounds", F.lit(None).cast("string").alias("node"), "up")
    state = state.unionAll(empty)
    for r in range(rounds):
        stride = F.lit(fanout**r).cast("bigint")
        digit = F.call_function("div", F.col("block"), stride) % f
        meets = F.col("rounds") > r
        place = F.when(meets, F.col("block") - digit * stride).otherwise(F.col("block"))
        rows = state.select("grp", place.alias("place"), F.struct(digit.alias("digit"), "block", "node", "blocks", "rounds", "up").alias("m"))
        met = rows.groupBy("grp", "place").agg(F.sort_array(F.collect_list("m")).alias("all"))
        nodes = F.array_compact(F.col("all.node"))
        above = F.when(F.size(nodes) > 0, F.sha2(F.array_join(nodes, ""), 256))
        each = met.select("grp", "all", above.alias("above"), F.explode("all").alias("m"))
        others = F.array_compact(F.transform(F.filter("all", lambda x: x["digit"] != F.col("m.digit")), lambda x: x["node"]))
        meets = F.col("m.rounds") > r
        state = each.select(
            "grp", "m.block", "m.blocks", "m.rounds",
            F.when(meets, F.col("above")).otherwise(F.col("m.node")).alias("node"),
            F.when(meets, F.concat("m.up", F.array(others))).otherwise(F.col("m.up")).alias("up"),
        )
        if r % ROUNDS_A_CUT == ROUNDS_A_CUT - 1:
            state = cut(roots.sparkSession, state, "butterfly")
    return state.where(F.col("block") < F.col("blocks")).select("grp", "block", F.col("node").alias("top"), "up")


def _tree(rows: DataFrame, order: list[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the trees over ``rows`` (grp, leaf, item, the columns of ``order``), and what each
    block has learned of its tree."""
    blocks = _blocks(_numbered(rows, order), fanout, levels)
    known = cut(rows.sparkSession, _butterfly(_block_roots(blocks, fanout, levels), fanout, levels), "known")
    return blocks, known


def _group_proofs(known: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, rank, root, over: each group's place among the groups, the root and its proof."""
    tops = known.where("block = 0").select(F.lit("").alias("grp"), F.unhex("top").alias("leaf"), F.col("grp").alias("item"))
    blocks, found = _tree(tops, ["item"], fanout, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                nodes = [x["leaf"].hex() for x in row["leaves"]]
                all_levels = build(nodes, fanout, _block_height(row["n"], fanout, levels))
                proofs = [siblings(all_levels, i, fanout) + row["up"] for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["item"] for x in row["leaves"]], pa.string()),
                        pa.array([x["pos"] for x in row["leaves"]], pa.int64()),
                        pa.array([row["top"]] * len(nodes), pa.string()),
                        pa.array(proofs, pa.list_(pa.list_(pa.string()))),
                    ],
                    ["grp", "rank", "root", "over"],
                )

    joined = blocks.join(found, ["grp", "block"]).select("n", "leaves", "top", "up")
    return joined.mapInArrow(run, "grp string, rank bigint, root string, over array<array<string>>")


def prove(
    docs: DataFrame,
    suspect: Column | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
    with_proof: bool = False,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``suspect`` gives the n_chars that a row is found to have now; its leaf is folded with the
    original siblings, and the row is verified if that leads to the root. With ``with_proof`` the
    lang and the proof itself (siblings by level) follow.
    """
    n_chars = F.col("n_chars")
    found = n_chars if suspect is None else suspect

    def digest(size: Column) -> Column:
        return leaf_digest(F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang"), size, F.col("text"))

    same = n_chars.cast("string").eqNullSafe(found.cast("string"))
    # "" for null, so that it sorts first; other groups begin with a mark
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    rows = docs.select(
        group.alias("grp"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(n_chars).alias("leaf"),
        F.when(~same, digest(found)).alias("now"),
    )
    rows = rows.select("grp", "doc_id", "leaf", F.struct("doc_id", "now").alias("item"))
    blocks, known = _tree(rows, ["doc_id", "leaf"], fanout, levels)
    over = cut(docs.sparkSession, _group_proofs(known, fanout, levels), "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names)}
                out = [_proved(row, at, fanout, levels, with_proof) for at in _opened(row, fanout, levels)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    fields = [pa.field("doc_id", pa.int64())]
    fields += [pa.field(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    fields.append(pa.field("verified", pa.bool_()))
    sql = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if with_proof:
        fields += [pa.field("lang", pa.string()), pa.field("proof", pa.list_(pa.list_(pa.string())))]
        sql += ", lang string, proof array<array<string>>"
    schema = pa.schema(fields)
    joined = blocks.join(known, ["grp", "block"]).join(over, "grp")
    return joined.select("grp", "n", "leaves", "top", "up", "rank", "root", "over").mapInArrow(run, sql)


def _opened(row: dict, fanout: int, levels: int) -> range:
    """Hash the block's own subtree; returns the places of its leaves."""
    nodes = [x["leaf"].hex() for x in row["leaves"]]
    row["height"] = _block_height(row["n"], fanout, levels)
    row["levels"] = build(nodes, fanout, row["height"])
    row["above"] = "".join(x for level in (*row["up"], *row["over"]) for x in level)
    row["folded"] = {}  # nodes of the block's top -> what they lead to
    return range(len(nodes))


def _proved(row: dict, at: int, fanout: int, levels: int, with_proof: bool) -> tuple:
    leaf, item, pos = row["leaves"][at]["leaf"].hex(), row["leaves"][at]["item"], row["leaves"][at]["pos"]
    below = siblings(row["levels"], at, fanout)
    now = item["now"].hex() if item["now"] is not None else leaf
    top = fold(now, pos, below, fanout)
    if top not in row["folded"]:
        subroot = fold(top, pos // fanout ** row["height"], row["up"], fanout)
        row["folded"][top] = fold(subroot, row["rank"], row["over"], fanout)
    root = row["folded"][top]
    proof = sha256(("".join(x for level in below for x in level) + row["above"]).encode()).hexdigest()
    out = (item["doc_id"], leaf, row["top"], row["root"], proof, root, root == row["root"])
    return (*out, row["grp"][1:] if row["grp"] else None, [*below, *row["up"], *row["over"]]) if with_proof else out


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """lang, n_rows, subroot, root: the published form of the tree, one row per group."""
    proved = prove(docs, fanout=fanout, levels=levels, with_proof=True)
    return proved.groupBy("lang", "subroot", "root").agg(F.count("*").alias("n_rows"))


def audit(docs: DataFrame) -> DataFrame:
    """``prove`` with one more character claimed where 7 divides the CRC-32 of the doc_id."""
    hit = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return prove(docs, F.when(hit, more).otherwise(F.col("n_chars").cast("decimal(20,0)")))


ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), fields AS (
  SELECT doc_id, lang, n_chars, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % {TAMPERED_EVERY} = 0 AS hit,
    concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'),
           coalesce(octet_length(encode(source)) || ':' || source, '-'),
           coalesce(octet_length(encode(lang)) || ':' || lang, '-')) AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents, crc
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp,
    sha256(concat(head, coalesce(len(n_chars::VARCHAR) || ':' || n_chars, '-'), tail)) AS leaf,
    sha256(concat(head, coalesce(len((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-'), tail)) AS now
  FROM fields
), placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low(grp, level, pos, node, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // {FANOUT}, sha256(string_agg(node, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT}
  FROM low WHERE n > 1 GROUP BY grp, level, pos // {FANOUT}, n
), subroots AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos FROM low WHERE n = 1),
top(level, pos, node, n) AS (
  SELECT 0, pos, node, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FANOUT}, sha256(string_agg(node, '' ORDER BY pos)), (n + {FANOUT - 1}) // {FANOUT}
  FROM top WHERE n > 1 GROUP BY level, pos // {FANOUT}, n
), nodes AS (
  SELECT grp, level, pos, node, 0 AS upper, n FROM low UNION ALL SELECT grp, t.level, t.pos, t.node, 1, t.n FROM top t, (SELECT grp FROM subroots)
), heights AS (SELECT grp, max(level) FILTER (WHERE upper = 0) AS h, max(level) FILTER (WHERE upper = 1) AS u FROM nodes GROUP BY grp),
steps AS (  -- the run of each leaf at each level
  SELECT p.doc_id, p.leaf, p.grp, p.pos, 0 AS upper, level, p.pos // ({FANOUT} ** level)::BIGINT AS at
  FROM placed p JOIN heights USING (grp), unnest(range(h)) AS l(level)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.grp, p.pos, 1, level, s.pos // ({FANOUT} ** level)::BIGINT
  FROM placed p JOIN subroots s USING (grp) JOIN heights USING (grp), unnest(range(u)) AS l(level)
), runs AS (
  SELECT s.grp, s.pos, s.upper, s.level,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (WHERE n.pos < s.at), '') AS before,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (WHERE n.pos > s.at), '') AS behind
  FROM steps s JOIN nodes n ON n.grp = s.grp AND n.upper = s.upper AND n.level = s.level AND n.pos // {FANOUT} = s.at // {FANOUT}
  GROUP BY s.grp, s.pos, s.upper, s.level
), numbered AS (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY upper, level) AS step FROM runs),
folded(grp, pos, step, node) AS (
  SELECT grp, pos, 0::BIGINT, now FROM placed
  UNION ALL
  SELECT f.grp, f.pos, r.step, sha256(concat(r.before, f.node, r.behind))
  FROM folded f JOIN numbered r ON r.grp = f.grp AND r.pos = f.pos AND r.step = f.step + 1
), ends AS (SELECT grp, pos, arg_max(node, step) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT grp, pos, string_agg(concat(before, behind), '' ORDER BY step) AS proof FROM numbered GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  folded_root, folded_root = t.node AS verified
FROM placed p JOIN subroots s USING (grp) JOIN ends e ON e.grp = p.grp AND e.pos = p.pos
  LEFT JOIN proofs q ON q.grp = p.grp AND q.pos = p.pos JOIN top t ON t.n = 1
"""
