"""Names resolved to taxa by normalized keys, under different policies for what is ambiguous (JN5-JN9, VAL3-VAL5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_index(taxa: DataFrame, key: Column, taxon: str, out: str) -> DataFrame:
    """(key, taxon) for keys that name exactly one taxon."""
    return taxa.select(key.alias(out), F.col(taxon).alias("_t")).where(f"{out} is not null and {out} <> ''").groupBy(out).agg(F.count_distinct("_t").alias("_n"), F.min("_t").alias("_id")).where("_n = 1").select(out, "_id")


def crosswalk(labels: DataFrame, key: Column, taxa: DataFrame, taxa_key: Column, taxon: str, overrides: DataFrame | None = None) -> DataFrame:
    """JN5, JN7: override first, else the unique taxon of the normalized name; `matches` tells 0 and several apart."""
    index = taxa.select(taxa_key.alias("_k"), F.col(taxon).alias("_t")).groupBy("_k").agg(F.count_distinct("_t").alias("_n"), F.min("_t").alias("_id"))
    j = labels.withColumn("_k", key).join(index, "_k", "left")
    if overrides is None:
        j = j.withColumn("_o", F.lit(None).cast("string"))
    else:
        j = j.join(overrides.select(F.col("key").alias("_k"), F.col("resolved").alias("_o")), "_k", "left")
    found = F.coalesce("_o", F.when(F.col("_n") == 1, F.col("_id")))
    how = F.when(F.col("_o").isNotNull(), "override").when(F.col("_n") == 1, "unique").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return j.select(*labels.columns, found.alias("resolved"), how.alias("policy"), F.coalesce("_n", F.lit(0)).alias("matches"))


def cascade(rows: DataFrame, scientific: Column, common: Column, own: Column, taxa: DataFrame, taxa_scientific: Column, taxa_common: Column, taxon: str) -> DataFrame:
    """JN6: unique scientific name, else unique common name, else an id of its own; never fails."""
    s, c = unique_index(taxa, taxa_scientific, taxon, "_s"), unique_index(taxa, taxa_common, taxon, "_c")
    j = rows.withColumn("_s", scientific).withColumn("_c", common)
    j = j.join(s.withColumnRenamed("_id", "_by_s"), "_s", "left").join(c.withColumnRenamed("_id", "_by_c"), "_c", "left")
    how = F.when(F.col("_by_s").isNotNull(), "scientific").when(F.col("_by_c").isNotNull(), "common").otherwise("own")
    return j.select(*rows.columns, F.coalesce("_by_s", "_by_c", own).alias("resolved"), how.alias("policy"))


def locked(rows: DataFrame, taxa: DataFrame, key: str, *fields: str) -> DataFrame:
    """JN8: rows whose key is unknown or whose fields differ from the taxon's; has to be empty."""
    j = rows.join(taxa.select(key, *[F.col(f).alias(f"_t_{f}") for f in fields], F.lit(True).alias("_known")), key, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_t_{f}"))
    return j.where(F.col("_known").isNull() | differs).select(*rows.columns)


def genus_members(labels: DataFrame, genus: Column, taxa: DataFrame, scientific: str, taxon: str) -> DataFrame:
    """JN9, SET4: for every label the sorted ids of all taxa of its genus. A genus has a bounded number of species."""
    species = taxa.select(F.split(F.lower(F.col(scientific)), " ")[0].alias("_g"), F.col(taxon).alias("_t"))
    j = labels.withColumn("_g", F.lower(genus)).join(species, "_g", "left")
    return j.groupBy(*labels.columns).agg(F.array_sort(F.collect_set("_t")).alias("members"))


def misaligned(a: DataFrame, b: DataFrame, position: str, name: str, key) -> DataFrame:
    """VAL3: positions at which two vocabularies hold different normalized names."""
    j = a.select(position, F.col(name).alias("_a")).join(b.select(position, F.col(name).alias("_b")), position, "full")
    return j.where(~key(F.col("_a")).eqNullSafe(key(F.col("_b")))).select(position, F.col("_a").alias("name_a"), F.col("_b").alias("name_b"))
