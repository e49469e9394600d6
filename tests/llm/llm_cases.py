"""Shared inputs of the training-data tests."""

import random
from pathlib import Path

import duckdb
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCUMENT)


def table(spark, name, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch(name, columns, sf_dir=SF):
    return duckdb.sql(f"SELECT {columns} FROM '{Path(sf_dir) / name}.parquet'").fetchall()


def sentence(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "One two three"),
    (5, "One two three"),  # a repeated row
    (6, "Ünï cødé 日本語 😀 <|endoftext|> it's  12345\n\n x"),
    (7, sentence(1, 300)),
    (8, sentence(1, 300)),
    (9, sentence(1, 150) + " x " + sentence(2, 150)),
    (10, "a " * 30_000),  # very long and all ties
    (11, sentence(3, 20_000, 50_000)),
    (12, "x" * 20_000),
    (None, sentence(1, 300)),
    (None, None),
    (12, "same id, other text"),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
