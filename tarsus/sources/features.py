"""Cached feature sets: validated scans, resumable sharded writes, pluggable encoders (SRC24, SRC25, SNK4, SNK10, EXT1-EXT3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.functions.vectors import all_finite, norm

Encoder = Callable[[list[str]], np.ndarray]


def violations(features: DataFrame, key: str, vector: str, label: str, width: int, classes: int, tolerance: float = 1e-3) -> DataFrame:
    """SRC24, SRC25, MTH5, VAL9, VAL29: (key, problem) of rows that no cache may hold."""
    v = F.col(vector)
    checks = [("width", F.size(v) == width), ("not finite", all_finite(v)), ("norm", F.abs(norm(v) - 1) <= tolerance), ("label", F.col(label).between(0, classes - 1))]
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks]))
    return features.select(key, F.explode(found).alias("problem"))


def misaligned(features: DataFrame, metadata: DataFrame, key: str, label: str) -> DataFrame:
    """VAL12: keys of one side only, or with different labels; has to be empty."""
    j = features.select(key, F.col(label).alias("_a"), F.lit(1).alias("_x")).join(metadata.select(key, F.col(label).alias("_b"), F.lit(1).alias("_y")), key, "full")
    return j.where(F.col("_x").isNull() | F.col("_y").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def encode_texts(texts: DataFrame, column: str, encoder: Encoder) -> DataFrame:
    """EXT1, EXT2, SET7: each distinct text once through a batched encoder; (text, features)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({column: b[column], "features": list(np.asarray(encoder(b[column].tolist()), float))})

    return texts.where(F.col(column).isNotNull()).select(column).distinct().mapInPandas(run, f"`{column}` string, features array<double>")


def hashing_encoder(width: int = 16) -> Encoder:
    """EXT3: a deterministic stand-in for a model: unit vectors drawn from the text's digest."""

    def encode(texts: list[str]) -> np.ndarray:
        import hashlib

        rows = [np.frombuffer(hashlib.shake_256(t.encode()).digest(4 * width), np.uint32).astype(float) / 2**31 - 1 for t in texts]
        out = np.array(rows)
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return encode


def write_missing(spark: SparkSession, features: DataFrame, path: str, key: str, shard_rows: int = 100_000) -> int:
    """SNK10: append the rows whose key the cache doesn't have yet, partitioned by shard; returns the cache's row count."""
    try:
        done = spark.read.parquet(path).select(key)
        features = features.join(done, key, "left_anti")
    except Exception as e:  # the cache doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    features.withColumn("shard", F.floor(F.col(key) / shard_rows)).write.mode("append").partitionBy("shard").parquet(path)
    return spark.read.parquet(path).count()
