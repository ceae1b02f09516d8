"""Small document tables for the training-data operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(seed, n, vocabulary=400):
    return " ".join(words(seed, n, vocabulary))


def clashing(df):
    """The same table with extra columns named like those an operator may add."""
    from pyspark.sql import functions as F

    extra = ["size", "shard", "bucket", "hash", "chunk", "start", "problem", "rank", "words", "component_id", "kept"]
    return df.withColumns({n: F.lit("x") for n in extra})
