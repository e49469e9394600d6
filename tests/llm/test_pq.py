import numpy as np
import pytest
from llm_cases import rows_of, table

from ledgerlens.llm import pq


def brute(rows, cosine=0.95):
    """All pairs, then the smallest id reachable."""
    out, kept = [], []
    for vec_id, v in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, np.float64)
        if vec_id is None or v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            out.append((vec_id, 0, vec_id, True))
        else:
            kept.append((vec_id, v / np.abs(v).max()))
    near = [[i != j and len(a) == len(b) and (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine for j, (_, b) in enumerate(kept)] for i, (_, a) in enumerate(kept)]
    label = [i for i, _ in kept]
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(near):
            low = min([label[i], *(label[j] for j, x in enumerate(row) if x)])
            changed |= low < label[i]
            label[i] = low
    out += [(i, sum(row), low, i == low) for (i, _), row, low in zip(kept, near, label, strict=True)]
    return sorted(out, key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


def near_copies(seed, n, dim, noise, start):
    """A chain's worth of copies: some link with each other, some only through others."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=dim)
    return [(start + i, [float(x) for x in (centre + noise * r.normal(size=dim)).astype(np.float32)]) for i in range(n)]


def test_whole_table(spark):
    docs = table(spark, "embeddings")
    got = pq.near_duplicates(docs)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute([(r.vec_id, r.embedding) for r in docs.collect()])
    assert rows_of(got) == want


@pytest.mark.parametrize(("lists", "block"), [(1, 16), (8, 16), (8, 5), (30, 4096)])
def test_large_groups_over_many_blocks(spark, lists, block):
    rows = near_copies(1, 90, 24, 0.18, 0) + near_copies(2, 40, 24, 0.05, 500) + near_copies(3, 60, 24, 3.0, 1000)
    rows += [(2000 + i, rows[100][1]) for i in range(30)]  # exact copies of a member
    got = rows_of(pq.near_duplicates(frame(spark, rows).repartition(4), lists=lists, block=block))
    assert got == brute(rows)
    assert len({r[2] for r in got}) > 3


def test_edge_rows(spark):
    r = np.random.default_rng(4)
    base = [float(x) for x in r.normal(size=11).astype(np.float32)]
    rows = [(5, base), (4, base), (4, base), (3, [4 * x for x in base]), (2, [-x for x in base]), (1, base[:10]), (0, base[:10])]
    rows += [(9, None), (10, []), (11, [0.0] * 11), (12, [1.0, None]), (13, [float("nan")] * 11), (14, [float("inf")] * 11), (None, base), (None, None)]
    rows += [(20, [2.5]), (21, [1.0]), (22, [-1.0]), (20, base)]
    assert rows_of(pq.near_duplicates(frame(spark, rows))) == brute(rows)


def test_extreme_components(spark):
    rows = [(1, [1e308, 1e308]), (2, [1.0, 1.0]), (3, [1e-300, 1e-300]), (4, [1e308, -1e308]), (5, [5e-324, 0.0]), (6, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(frame(spark, rows, "double")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_empty_table_and_clashing_columns(spark):
    assert pq.near_duplicates(frame(spark, [])).collect() == []
    assert pq.near_duplicates(frame(spark, [(1, None)])).collect() == [(1, 0, 1, True)]
    rows = near_copies(5, 20, 9, 0.1, 0)
    more = frame(spark, rows).selectExpr("*", *[f"1 AS {c}" for c in ("first", "size", "cid", "list", "block", "label", "links", "kept")])
    assert rows_of(pq.near_duplicates(more)) == brute(rows)


def test_codes_spare_the_rerank():
    """Few pairs without a link are reranked, and every link is found."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 64))
    v = np.concatenate([centres[r.integers(0, 40, 500)] + 0.05 * r.normal(size=(500, 64)), r.normal(size=(1500, 64))])
    model = pq.Model(v, 32)
    lists, codes, square, error, away = model.encode(pq._unit(v))
    radii = np.array([away[lists == k].max(initial=0) for k in range(32)])
    cells = pq.Block.pack({"cid": np.arange(2000), "size": np.ones(2000), "length": np.full(2000, 64), "list": lists, "square": square, "error": error, "codes": codes, "vec": v})
    block = pq.Block(cells)
    links, _, _, reranked = pq.meet(block, block, True, model, radii, 0.95)
    unit = pq._unit(v)
    want = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    assert (links == want).all() and want.sum() > 1000
    assert reranked < 0.02 * 2000 * 1999 / 2 + want.sum() / 2


def test_layout_covers_every_list():
    counts = {0: 3, 1: 10, 2: 4, 4: 25, 5: 1, 6: 9}
    first, many = pq._layout(counts, 7, 10)
    assert many == [1, 1, 1, 0, 3, 1, 1]
    load = {}
    for k, n in counts.items():
        for b in range(first[k], first[k] + many[k]):
            load[b] = load.get(b, 0) + n / many[k]
    assert max(load.values()) <= 10
