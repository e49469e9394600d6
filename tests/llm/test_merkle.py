import zlib
from hashlib import sha256

import pytest
from llm_cases import DOCUMENT, EDGE, documents, rows_of, table
from pyspark.sql import functions as F

from ledgerlens.llm import merkle


def digest(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return out


def brute(rows, fanout=2, every=7):
    """The tree by its definition: whole levels in lists, each proof and fold walked by itself."""
    groups = {}
    for d, text, lang, source, n in rows:
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % every == 0
        groups.setdefault(lang, []).append((d, digest(d, source, lang, n, text), digest(d, source, lang, n + hit if n is not None else None, text)))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = levels_of([r[1] for r in groups[g]], fanout)
    top = levels_of([trees[g][-1][0] for g in keys], fanout)
    out = []
    for rank, g in enumerate(keys):
        for pos, (d, leaf, now) in enumerate(groups[g]):
            proof, node = "", now
            for levels, at in ((trees[g], pos), (top, rank)):
                for level in levels[:-1]:
                    run = level[at - at % fanout : at - at % fanout + fanout]
                    k = at % fanout
                    proof += "".join(run[:k] + run[k + 1 :])
                    node = sha256("".join(run[:k] + [node] + run[k + 1 :]).encode()).hexdigest()
                    at //= fanout
            root = top[-1][0]
            out.append((d, leaf, trees[g][-1][0], root, sha256(proof.encode()).hexdigest(), node, node == root))
    return sorted(out, key=repr)


def collected(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def test_whole_table(spark):
    docs = table(spark, "documents")
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(collected(docs))
    assert rows_of(got) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 3), (3, 1), (5, 2)])
def test_rounds_of_the_exchange(spark, fanout, levels):
    """Small blocks: several rounds, groups that fill no power of the fanout, and a lone leaf."""
    sizes = {"a": 2, "b": 33, "c": 1, "d": 64, "": 7, None: 19, "é": 5, "z": 9}
    rows = [(1000 * g + i, f"text {i}", lang) for g, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    docs = documents(spark, rows).repartition(5)
    assert rows_of(merkle.prove(docs, tampered(), fanout, levels)) == brute(collected(docs), fanout)


def test_edge_rows(spark):
    docs = documents(spark, [*EDGE, (2**63 - 1, "large", None), (-7, "negative", None)]).repartition(4)
    assert rows_of(merkle.audit(docs)) == brute(collected(docs))


def test_largest_size_and_null_size(spark):
    docs = spark.createDataFrame([(i, "t", "en", None, None if i % 2 else 2**63 - 1) for i in range(40)], DOCUMENT)
    assert rows_of(merkle.audit(docs)) == brute(collected(docs))


def test_hot_id_and_empty_table(spark):
    docs = documents(spark, [(7, "same")] * 300 + [(i, f"t{i}") for i in range(50)]).repartition(8)
    assert rows_of(merkle.prove(docs, tampered(), 2, 3)) == brute(collected(docs))
    assert merkle.audit(documents(spark, [])).collect() == []


def test_proofs_and_manifest(spark):
    docs = documents(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(21)])
    rows = merkle.prove(docs, fanout=2, levels=2, with_proof=True).collect()
    for r in rows:
        assert r.proof_sha256 == sha256("".join(x for level in r.proof for x in level).encode()).hexdigest()
        assert r.verified and r.folded_root == r.root
    groups = {(r.lang, r.n_rows, r.subroot) for r in merkle.manifest(docs, levels=2).collect()}
    assert groups == {(lang, n, next(r.subroot for r in rows if r.lang == lang)) for lang, n in (("a", 11), ("b", 10))}


def test_clashing_columns(spark):
    docs = documents(spark, EDGE).withColumns({c: F.lit(1) for c in ("grp", "leaf", "pos", "n", "row", "part", "block", "item", "now")})
    assert rows_of(merkle.audit(docs)) == rows_of(merkle.audit(documents(spark, EDGE)))
