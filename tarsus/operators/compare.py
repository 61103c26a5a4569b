"""Failure sets of two runs: identity join, categories, transition matrix, overlaps (JN4, AG18-AG21, TK3, SET1, VAL14, VAL17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsus.operators.paired import CATEGORIES, category


def joined_runs(a: DataFrame, b: DataFrame, key: str, identity: tuple[str, ...]) -> DataFrame:
    """JN4: one row a sample of both runs, columns with the suffixes _a and _b. Identity columns have to agree."""
    left = a.select(F.col(key), *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    right = b.select(F.col(key), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in identity], F.lit(True))
    return left.join(right, key).where(same)


def run_mismatches(a: DataFrame, b: DataFrame, key: str, identity: tuple[str, ...]) -> DataFrame:
    """JN1, JN4: keys that only one run has, or whose identity columns differ; has to be empty."""
    left = a.select(F.col(key), *[F.col(c).alias(f"{c}_a") for c in identity], F.lit(True).alias("_in_a"))
    right = b.select(F.col(key), *[F.col(c).alias(f"{c}_b") for c in identity], F.lit(True).alias("_in_b"))
    differs = reduce(lambda x, y: x | y, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in identity], F.lit(False))
    problem = F.when(F.col("_in_b").isNull(), "only in a").when(F.col("_in_a").isNull(), "only in b").when(differs, "identity")
    return left.join(right, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def run_summary(run: DataFrame, before: str, after: str, in_topk: str) -> DataFrame:
    """AG18, AG22: category counts and percentages, candidate recall, and the degraded share of what was right before."""
    n, c = F.count(F.lit(1)), category(F.col(before), F.col(after))
    counts = [F.count_if(c == k).alias(k) for k in CATEGORIES]
    right = F.nullif(F.count_if(F.col(before)), F.lit(0))
    return run.agg(
        n.alias("total"), *counts, (100.0 * F.count_if(F.col(in_topk)) / n).alias("candidate_recall"),
        (100.0 * F.count_if(c == "degraded") / right).alias("degraded_of_correct"), (100.0 * F.count_if(c == "recovered") / F.nullif(F.count_if(~F.col(before)), F.lit(0))).alias("recovered_of_wrong"),
    )


def transition_matrix(joined: DataFrame, a: str, b: str) -> DataFrame:
    """AG19: counts of category a by category b, all cells present."""
    frame = joined.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    cells = joined.groupBy(F.col(a).alias("category")).pivot(b, list(CATEGORIES)).count()
    return frame.join(cells, "category", "left").fillna(0)


def overlap(joined: DataFrame, a: str, b: str) -> DataFrame:
    """AG20, SET1: per category the samples in both runs, in one only, and the Jaccard share; null if in neither."""
    parts = []
    for c in CATEGORIES:
        x, y = F.col(a) == c, F.col(b) == c
        both, union = F.count_if(x & y), F.count_if(x | y)
        parts.append(joined.agg(F.lit(c).alias("category"), both.alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), (100.0 * both / F.nullif(union, F.lit(0))).alias("jaccard_percent")))
    return reduce(DataFrame.unionByName, parts)


def wrong_counters(joined: DataFrame, flags: list[str]) -> DataFrame:
    """AG21: samples that all of the flags, or both of a run's flags, have wrong."""
    everything = reduce(lambda x, y: x & y, [~F.col(f) for f in flags])
    return joined.agg(F.count_if(everything).alias("all_wrong"), F.count_if(~F.col(flags[0]) & ~F.col(flags[1])).alias("both_wrong_a"), F.count_if(~F.col(flags[2]) & ~F.col(flags[3])).alias("both_wrong_b"))


def most_common(rows: DataFrame, value: str, order: str, n: int = 12) -> DataFrame:
    """TK3: the n most common values, ties by first occurrence. The limit is the feature: a top-n report."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("samples"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("samples"), "first_seen").limit(n)


def ranking_changes(a: DataFrame, b: DataFrame, key: str, ranking: str) -> DataFrame:
    """VAL14, VAL17, ARR2: per sample whether two rankings are equal, hold the same classes, and where they first differ."""
    j = a.select(key, F.col(ranking).alias("_a")).join(b.select(key, F.col(ranking).alias("_b")), key)
    differs = F.array_position(F.zip_with("_a", "_b", lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return j.select(key, (F.col("_a") == F.col("_b")).alias("equal"), (F.array_sort("_a") == F.array_sort("_b")).alias("same_classes"), F.nullif(differs, F.lit(0)).alias("first_difference"))
