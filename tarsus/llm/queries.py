"""Queries of the problems tagged llm over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.llm import encoding, knn, leakage, minhash, mixing, names, overlap, splits
from tarsus.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return minhash.look_alike_groups(table(spark, d, "samples"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between different hashes, and how many the bands found and lost."""
    return minhash.link_audit(table(spark, d, "samples"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_records(table(spark, d, "samples"))


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "samples"))[0]


def p3_assignment_tied(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "samples"), ("group_id", "taxon_id"))[0]


def p3_assignment_increment(spark: SparkSession, d: str) -> DataFrame:
    """A run over half of the records, then one over all that takes up its component table and ties taxa as well."""
    samples = table(spark, d, "samples")
    first = splits.assign_splits(samples.where("record_id % 2 = 0"))[1]
    return splits.assign_splits(samples, ("group_id", "taxon_id"), previous=first)[0]


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.share_report(splits.assign_splits(table(spark, d, "samples"))[0])


def p3_torn_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_components(table(spark, d, "samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "samples"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "samples"))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.record_coverage(table(spark, d, "samples"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    tables = [table(spark, d, n) for n in ("taxon_overrides", "wetland_alignments")]
    return names.resolve(names.open_cases(table(spark, d, "samples"), *tables), names.reference_names(table(spark, d, "taxa"), *tables))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("entry_kind", "entry_id", "taxon_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return names.unmatched(_resolved(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest_neighbours(table(spark, d, "cached_features")).select("vector_id", "neighbour_id")


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "cached_features")
    labels = vectors.groupBy(F.col("vector_id").alias("neighbour_id")).agg(F.min("label").alias("neighbour_label"))
    return knn.nearest_neighbours(vectors).join(labels, "neighbour_id").select("vector_id", "neighbour_id", "similarity", "neighbour_label")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*mixing.draw_mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired_documents(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired_documents(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p3_found": p3_found,
    "p3_assignment": p3_assignment,
    "p3_assignment_tied": p3_assignment_tied,
    "p3_assignment_increment": p3_assignment_increment,
    "p3_shares": p3_shares,
    "p3_torn_groups": p3_torn_groups,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_coverage": p7_coverage,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_cleaned": p8_cleaned,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
