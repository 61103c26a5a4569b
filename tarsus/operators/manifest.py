"""Manifest checks, filters, duplicate audits and digests (FIL1-FIL11, JN1-JN3, JN10, JN15, AG13-AG17, AG23-AG28, AG34, VAL*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_view(samples: DataFrame, split: str, included: DataFrame | None = None, excluded: DataFrame | None = None, split_col: str = "source_split", taxon: str = "taxon_id") -> DataFrame:
    """FIL1, JN15: rows of one split whose taxon is included and not excluded: a semi and an anti join."""
    out = samples.where(F.col(split_col) == split)
    if included is not None:
        out = out.join(included.select(taxon), taxon, "left_semi")
    return out if excluded is None else out.join(excluded.select(taxon), taxon, "left_anti")


def compact_task(rows: DataFrame, label: str, taxon: str, excluded: DataFrame | None = None) -> DataFrame:
    """FIL2: rows of retained taxa with labels from 0 in the order of their source labels; taxa without rows get none."""
    kept = rows if excluded is None else rows.join(excluded.select(taxon), taxon, "left_anti")
    labels = kept.select(label).distinct().withColumn("task_label", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(label)) - 1)
    return kept.join(labels, label)


def unknown_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """JN2, JN3: facts whose key the dimension doesn't have; null keys are not looked up."""
    return facts.where(F.col(key).isNotNull()).join(dimension.select(key), key, "left_anti")


def key_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET2: keys that one side only has, and which."""
    j = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return j.select(key, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").alias("problem")).where("problem is not null")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """VAL1, SET9: keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def conflicting(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AG34, VAL24: keys with several values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def group_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """AG13."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def mismatch_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """AG14."""
    return rows.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))


def exclusion_audit(samples: DataFrame, excluded: DataFrame, taxon: str, *by: str) -> DataFrame:
    """FIL7, AG23: rows and taxa that an exclusion list removes and keeps, per group."""
    flagged = samples.join(excluded.select(taxon, F.lit(True).alias("_out")).distinct(), taxon, "left")
    out = F.col("_out").isNotNull()
    return flagged.groupBy(*by).agg(
        F.count_if(out).alias("excluded"), F.count_if(~out).alias("retained"), F.count_distinct(F.when(out, F.col(taxon))).alias("excluded_taxa"), F.count_distinct(F.when(~out, F.col(taxon))).alias("retained_taxa")
    )


def duplicate_audit(samples: DataFrame, digest: str, dataset: str, order: list[str], taxon: str, active: Column | None = None) -> DataFrame:
    """AG16, WN8: samples whose digest occurs in several datasets, with their canonical dataset and whether they drop.

    The first row in order is canonical. Active rows of later datasets drop; copies within the canonical dataset stay,
    inactive rows are reported and never dropped. Group facts are aggregated before the shuffle and joined back, so no
    group is collected.
    """
    first = F.min_by(F.col(dataset), F.struct(*order))
    groups = samples.where(F.col(digest).isNotNull()).groupBy(digest).agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct(dataset).alias("datasets"), first.alias("canonical_dataset"), (F.count_distinct(taxon) > 1).alias("taxon_conflict")
    )
    joined = samples.join(groups.where("datasets > 1"), digest)
    return joined.withColumn("drops", (active if active is not None else F.lit(True)) & (F.col(dataset) != F.col("canonical_dataset")))


def near_pairs(samples: DataFrame, value: str, dataset: str, threshold: int) -> DataFrame:
    """JN10: pairs of distinct 64-bit values of at most `threshold` differing bits that occur in different datasets.

    One of threshold + 1 chunks has to agree, so an equi-join over (chunk number, chunk) finds every pair; threshold 0
    gives none. Values are folded first, with their occurrences and the least and greatest dataset.
    """
    values = samples.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(dataset).alias("lo"), F.max(dataset).alias("hi"))
    n = threshold + 1
    cut = [64 * i // n for i in range(n + 1)]
    chunks = F.array(*[F.shiftrightunsigned(F.col("v"), lo).bitwiseAND(F.lit((1 << min(63, hi - lo)) - 1)) for lo, hi in zip(cut, cut[1:])])
    keyed = values.select("*", F.posexplode(chunks).alias("part", "chunk"))
    other = keyed.select(*[F.col(c).alias(f"{c}_b") if c not in ("part", "chunk") else F.col(c) for c in keyed.columns])
    distance = F.bit_count(F.col("v").bitwiseXOR(F.col("v_b")))
    across = (F.col("lo") != F.col("hi_b")) | (F.col("hi") != F.col("lo_b"))
    found = keyed.join(other, ["part", "chunk"]).where((F.col("v") < F.col("v_b")) & (distance <= threshold) & across & F.lit(threshold > 0))
    return found.select(F.col("v").alias("value_a"), F.col("v_b").alias("value_b"), distance.alias("distance"), F.col("n").alias("count_a"), F.col("n_b").alias("count_b")).distinct()


def content_digest(rows: DataFrame, by: list[str], order: str, row: Column, out: str = "digest") -> DataFrame:
    """AG25, SNK2: an order-sensitive SHA-256 of a group's rows as a two-level tree.

    Every row is hashed where it lies. The rows of a bucket (4096 by the hash of the order key) are digested in order,
    then the buckets' digests; a group of any size gathers one 4096th of its row digests in a task.
    """
    bucket = F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 3)
    lines = rows.select(*by, bucket.alias("_b"), F.struct(order, F.sha2(row, 256).alias("_h")).alias("_s"))
    packed = lines.groupBy(*by, "_b").agg(F.array_sort(F.collect_list("_s")).alias("_l"))
    digests = packed.select(*by, F.struct("_b", F.sha2(F.array_join(F.transform("_l", lambda s: s["_h"]), "\n"), 256).alias("_h")).alias("_s"), F.size("_l").cast("bigint").alias("_n"))
    top = digests.groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("_l"), F.sum("_n").alias("rows"))
    return top.select(*by, F.sha2(F.array_join(F.transform("_l", lambda s: s["_h"]), "\n"), 256).alias(out), "rows")


def coverage(frames: DataFrame, video: str, frame: str, lengths: DataFrame, stride: int) -> DataFrame:
    """AG28, FIL8: annotated frames, the horizon they reach, unannotated frames after it, and the same at a stride."""
    seen = frames.groupBy(video).agg(F.count_distinct(frame).alias("annotated"), (F.max(frame) + 1).alias("horizon"), F.count_distinct(F.when(F.col(frame) % stride == 0, F.col(frame))).alias("sampled_annotated"))
    j = lengths.join(seen, video, "left").fillna(0, ["annotated", "horizon", "sampled_annotated"])
    sampled = F.ceil(F.col("length") / stride)
    return j.select(video, "length", "annotated", "horizon", (F.col("length") - F.col("horizon")).alias("trailing"), sampled.alias("sampled"), "sampled_annotated", (sampled - F.ceil(F.col("horizon") / stride)).alias("sampled_trailing"))


def partition_audit(rows: DataFrame, dataset: str, status: str, taxon: str) -> DataFrame:
    """AG24: per dataset, rows and taxa, and rows by status as a map."""
    by_status = rows.groupBy(dataset, status).agg(F.count(F.lit(1)).alias("_n"))
    maps = by_status.groupBy(dataset).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), F.col("_n"))))).alias("status_counts"))  # one entry a status
    taxa = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(taxon).alias("taxa"))
    return taxa.join(maps, dataset)


def overridden(base: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """SET8: the base with the overrides' values in place of its own where a key has one."""
    o = overrides.select(*keys, F.col(value).alias("_new"))
    return base.join(o, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def first_occurrences(rows: DataFrame, value: str, order: str) -> DataFrame:
    """SET3, VAL18: distinct values in order of first occurrence."""
    return rows.groupBy(value).agg(F.min(order).alias("first_seen"))
