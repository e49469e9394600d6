"""Corpus pipeline: language ID, near-duplicate removal, substring deduplication, benchmark
decontamination, BPE encoding and decoding. Each stage is one operator of ``ledgerlens.llm``
over all that the stage before it kept.

Each stage's result is written to the shared folder and read back, so a lost executor costs work
of one stage only, and no stage plans on top of another's lineage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, decontam, lang_id, neardup, substring
from ledgerlens.llm.queries import table
from ledgerlens.llm.shipping import ship
from ledgerlens.llm.storage import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go, all others stay, also where no language was learned."""
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = lang_id.identify(docs, lang_id.train(docs), letters=True).toDF(*names, "lang_pred", "score", "has_letter")
    return found.where("has_letter").select(*names).toDF(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    ship(spark)
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that start earlier as well."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring.remove_repeats(docs, with_text=True, keep=tuple(others))
    out = out.toDF("doc_id", "n", "gone", "sha", "text", *[f"k{i}" for i in range(len(others))])
    column = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"k{i}") for i, c in enumerate(others)}
    if "n_chars" in column:
        column["n_chars"] = F.when(F.col("gone") > 0, F.char_length("text").cast("bigint")).otherwise(column["n_chars"])
    return out.select(*[column[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    ship(spark)
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None  # SQL can express neither the trained model nor BPE: tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
