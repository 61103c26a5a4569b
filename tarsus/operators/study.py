"""Checks of a study's runs: cells, configurations, embedded results, metrics, rows of predictions (JN17, PRJ8, AG27, VAL13, VAL20-VAL25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsus.operators import paired


def top_problems(rows: DataFrame, key: str, ids: str, names: str, classes: DataFrame, k: int = 5) -> DataFrame:
    """VAL20: (key, problem) of rows whose top-k is not k different ids of the classes, or whose names are not theirs.

    classes: (class_id, name), broadcast as one map, as they are a vocabulary. Nulls are broken.
    """
    known = classes.agg(F.map_from_entries(F.collect_list(F.struct(F.col("class_id").cast("int"), F.col("name")))).alias("_names"))
    j = rows.crossJoin(F.broadcast(known))
    i = F.col(ids).cast("array<int>")
    checks = [
        ("width", F.size(i) == k),
        ("repeated", F.size(F.array_distinct(i)) == F.size(i)),
        ("unknown class", F.forall(i, lambda x: F.map_contains_key("_names", x))),
        ("names", F.col(names) == F.transform(i, lambda x: F.try_element_at("_names", x))),
    ]
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks]))
    return j.select(key, F.explode(found).alias("problem"))


def config_problems(configs: DataFrame, expected: DataFrame, run: str, by: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """VAL21: (run, field_path, problem) of configured values other than expected: missing, unexpected, kind or value.

    Both sides are long, (run, by, field_path, kind, value) and (by, field_path, kind, value), compared without
    coercion. Fields that may differ between runs, as the seed does, are ignored: what is left is the invariant part.
    """
    runs = configs.select(run, by).distinct()
    want = runs.join(expected.where(~F.col("field_path").isin(*ignored)).select(by, "field_path", F.col("kind").alias("_k"), F.col("value").alias("_v"), F.lit(True).alias("_want")), by)
    have = configs.where(~F.col("field_path").isin(*ignored)).select(run, "field_path", "kind", "value", F.lit(True).alias("_have"))
    j = want.join(have, [run, "field_path"], "full")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_k") != F.col("kind"), "kind").when(~F.col("_v").eqNullSafe(F.col("value")), "value")
    return j.select(run, "field_path", problem.alias("problem")).where("problem is not null")


def cell_problems(cells: DataFrame, runs: DataFrame, cell: list[str], complete: Column) -> DataFrame:
    """VAL22: (cell..., complete_runs, problem) of cells that have not exactly one complete run: none, or several."""
    counts = runs.groupBy(*cell).agg(F.count_if(complete).alias("complete_runs"))
    j = cells.select(*cell).join(counts, cell, "left").fillna(0, ["complete_runs"])
    return j.where("complete_runs <> 1").withColumn("problem", F.when(F.col("complete_runs") == 0, "missing").otherwise("several"))


def embedded_problems(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """VAL23, JSN1: (key, field_path, problem): where a result and the copy embedded elsewhere differ, field by field,
    kinds included; both long: (key, field_path, kind, value)."""
    left = a.select(key, "field_path", F.struct("kind", "value").alias("_a"))
    right = b.select(key, "field_path", F.struct("kind", "value").alias("_b"))
    j = left.join(right, [key, "field_path"], "full")
    problem = F.when(F.col("_b").isNull(), "not embedded").when(F.col("_a").isNull(), "only embedded").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return j.select(key, "field_path", problem.alias("problem")).where("problem is not null")


def metric_problems(rows: DataFrame, key: str, correct: str, total: str, percent: str, tolerance: float = 1e-10) -> DataFrame:
    """VAL25: (key, problem) of metrics that are not finite, count more right than there are, or are not 100 correct / total."""
    c, n, p = F.col(correct), F.col(total), F.col(percent)
    checks = [("finite", p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))), ("counts", (c >= 0) & (c <= n) & (n > 0)), ("percent", F.abs(p - 100.0 * c / n) <= tolerance)]
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in checks]))
    return rows.select(key, F.explode(found).alias("problem"))


def zipped_problems(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """JN17: (key, position, left, right): places at which two lists of a row differ; the shorter one has nulls at its end."""
    pairs = rows.select(key, F.posexplode(F.arrays_zip(F.col(left).alias("_l"), F.col(right).alias("_r"))).alias("position", "_p"))
    return pairs.where(~F.col("_p._l").eqNullSafe(F.col("_p._r"))).select(key, "position", F.col("_p._l").alias("left_value"), F.col("_p._r").alias("right_value"))


def target_margin(ranked: Column, target: Column, cls: str = "class_id") -> Column:
    """PRJ8: the target's score less the best other class's; null where the target is not ranked."""
    own = F.get(F.filter(ranked, lambda s: s[cls] == target), F.lit(0))["score"]
    best = F.get(F.filter(ranked, lambda s: s[cls] != target), F.lit(0))["score"]
    return own - best


def vector_digest(rows: DataFrame, by: list[str], key: str, vector: str, places: int = 6) -> DataFrame:
    """AG27: one digest a group over its vectors in key order, in units of the last decimal place."""
    from tarsus.operators.manifest import content_digest

    units = F.transform(F.col(vector), lambda x: F.round(x * 10**places).cast("bigint").cast("string"))
    return content_digest(rows, by, key, F.concat_ws("|", F.col(key).cast("string"), F.array_join(units, ",")))


def comparison(rows: DataFrame, before: str, after: str, reps: int = 10_000, seed: int = 2026) -> DataFrame:
    """VAL13: transitions, the exact test and the bootstrap interval of one comparison in one row."""
    t, m = paired.transitions(rows, before, after), paired.mcnemar(rows, before, after).select("discordant", "p_value")
    b = paired.bootstrap_gain(rows, F.col(after).cast("int") - F.col(before).cast("int"), reps, seed).drop("total")
    return t.crossJoin(m).crossJoin(b)  # one row each
