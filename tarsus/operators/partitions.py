"""Splits and label spaces by salted hashes: reproducible on every engine, independent of input order (WN2-WN7, FIL9, TRN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.runtime import materialize


def split_score(seed: str, key: Column) -> Column:
    """HSH2: SHA-256 of seed, NUL, key."""
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key.cast("string")), 256)


def stratified_split(rows: DataFrame, cls: str, key: str, per_class: int, seed: str, tie: str | None = None) -> DataFrame:
    """WN2, WN3: the first per_class rows of each class by hash are validation, the others fit.

    The first ones are taken by a limit per group, which every task applies before the shuffle, and joined back by class
    and key; no class is sorted as a whole. A row without a class or key is fit.
    """
    w = W.partitionBy(cls).orderBy(split_score(seed, F.col(key)), tie or key)
    taken = rows.select(*dict.fromkeys([cls, key, *([tie] if tie else [])])).where(F.col(cls).isNotNull() & F.col(key).isNotNull())
    taken = taken.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_class).select(cls, key, F.lit(True).alias("_taken"))
    return rows.join(taken, [cls, key], "left").withColumn("part", F.when(F.col("_taken"), "validation").otherwise("fit")).select(*rows.columns, "part")


def short_classes(rows: DataFrame, cls: str, per_class: int) -> DataFrame:
    """WN2: classes that a stratified split would leave without fit rows; has to be empty."""
    return rows.groupBy(cls).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") <= per_class)


def adjacent_split(classes: DataFrame, class_id: str, name: str, salt: str) -> DataFrame:
    """WN4: of every two adjacent class ids one is base and one novel, by the hash of salt, id and name."""
    score = F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), F.col(class_id).cast("string"), F.char(F.lit(0)), F.col(name)), 256)
    w = W.partitionBy(F.floor(F.col(class_id) / 2)).orderBy(score, class_id)
    return classes.withColumn("part", F.when(F.row_number().over(w) == 1, "base").otherwise("novel"))


def taxon_partition(taxa: DataFrame, taxon: str, fraction: float, salt: str) -> DataFrame:
    """WN5: the first round(n * fraction) taxa by hash are validation, at least one, and one at least is left to train.

    Halves are rounded to even. Taxa are a dimension of bounded size, which is why one window may order them all.
    """
    one = W.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(one)
    count = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction), 0).cast("bigint")))
    rank = F.row_number().over(one.orderBy(split_score(salt, F.col(taxon))))
    return taxa.withColumn("part", F.when(rank <= count, "validation").otherwise("train"))


def local_labels(rows: DataFrame, taxon: str, out: str = "local_label") -> DataFrame:
    """WN6: dense labels from 0 over the sorted taxa. The taxa are ranked alone, and joined back."""
    ranked = rows.where(F.col(taxon).isNotNull()).select(taxon).distinct().withColumn(out, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(taxon)) - 1)
    return rows.join(ranked, taxon, "left")


def numbered(rows: DataFrame, *order: str, out: str = "position") -> DataFrame:
    """Rows with their place from 0 in the order of columns that tell them apart: ranges of the order, sorted each on its
    own, after the sizes of the ranges before. One number a range comes to the driver."""
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dict(map(tuple, ranged.groupBy("_range").agg(F.count(F.lit(1))).collect()))
    starts, at = [], 0
    for i in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(i, 0)
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    start = F.get(F.lit(starts or [0]), F.col("_range"))
    return ranged.withColumn(out, (start + place).cast("bigint")).drop("_range")


def refit_rows(parts: list[tuple[str, DataFrame]], taxon: str, index: str, dropped: DataFrame | None = None) -> DataFrame:
    """WN7, SET5: rows of several splits as one, with labels over the union of their taxa and a running row number.

    `dropped` (part, index) rows are left out first. The number runs through the splits in their order, by index.
    """
    union = None
    for n, (name, df) in enumerate(parts):
        one = df.select(F.lit(n).alias("part_no"), F.lit(name).alias("part"), F.col(index), F.col(taxon))
        union = one if union is None else union.unionByName(one)
    if dropped is not None:
        union = union.join(dropped, ["part", index], "left_anti")
    return numbered(local_labels(union, taxon, "label"), "part_no", index)


def balanced_draws(rows: DataFrame, cls: str, key: str, draws: int, seed: str) -> DataFrame:
    """TRN5: draws with replacement that choose a class first and a row of it second, both from hashes of the draw."""
    spark = rows.sparkSession
    classes = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    classes = classes.withColumn("_c", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(cls)) - 1).withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    numbered = rows.select(cls, key).withColumn("_r", F.row_number().over(W.partitionBy(cls).orderBy(key)) - 1)
    k = classes.agg(F.max("_k").alias("_k"))

    def number(what: str) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(what), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("bigint")

    asked = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(k)).withColumn("_c", number("class") % F.col("_k")).drop("_k")
    asked = asked.join(classes.select(cls, "_n", "_c"), "_c").withColumn("_r", number("row") % F.col("_n"))
    return asked.join(numbered, [cls, "_r"]).select("draw", cls, key)
