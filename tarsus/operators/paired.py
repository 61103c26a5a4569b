"""Paired outcomes of two systems: transitions, exact McNemar, bootstraps, seeds (AG4-AG9, AG32, AG33, PRJ2, VAL13)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Fixed value: the 97.5 % point of Student's t with two degrees of freedom.
T_TWO_DF = 4.302652729911275
CATEGORIES = ("both_correct", "recovered", "degraded", "both_wrong")


def category(before: Column, after: Column) -> Column:
    """PRJ2: the four-way outcome."""
    return F.when(before & after, "both_correct").when(~before & after, "recovered").when(before & ~after, "degraded").when(~before & ~after, "both_wrong")


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    """AG4: total, four counts and their percentages, in one aggregate."""
    n, c = F.count(F.lit(1)), category(F.col(before), F.col(after))
    counts = [F.count_if(c == k).alias(k) for k in CATEGORIES]
    shares = [(100.0 * F.count_if(c == k) / n).alias(f"{k}_percent") for k in CATEGORIES]
    return rows.agg(n.alias("total"), *counts, *shares)


def binomial_p(recovered: int, degraded: int) -> float:
    """Exact two-sided p of a fair binomial in whole numbers."""
    n, k = recovered + degraded, min(recovered, degraded)
    tail = sum(math.comb(n, i) for i in range(k + 1))
    return float(min(Fraction(1), Fraction(2 * tail, 2**n)))


@pandas_udf(T.DoubleType())
def exact_mcnemar_p(recovered: pd.Series, degraded: pd.Series) -> pd.Series:
    """AG5 in arbitrary precision, for p-values below what logarithms resolve; one call a comparison, not a row."""
    return pd.Series([binomial_p(int(a), int(b)) for a, b in zip(recovered, degraded)])


def mcnemar_p(recovered: Column, degraded: Column) -> Column:
    """AG5: exact two-sided p by a log-space sum, JVM-side; 1 without discordant pairs."""
    n, k = recovered + degraded, F.least(recovered, degraded)
    steps = F.transform(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), lambda i: i)
    logs = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.when(i == 0, F.struct(F.lit(0.0).alias("log"), F.exp(-n * math.log(2.0)).alias("sum"))).otherwise(
            F.struct((s["log"] + F.ln((n - i + 1) / F.greatest(i, F.lit(1)))).alias("log"), (s["sum"] + F.exp(s["log"] + F.ln((n - i + 1) / F.greatest(i, F.lit(1))) - n * math.log(2.0))).alias("sum"))
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * logs))


def mcnemar(rows: DataFrame, before: str, after: str) -> DataFrame:
    """AG5: total, recovered, degraded, discordant and the exact p-value of the paired outcomes."""
    b, a = F.col(before), F.col(after)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~b & a).alias("recovered"), F.count_if(b & ~a).alias("degraded"))
    return counts.withColumn("discordant", F.col("recovered") + F.col("degraded")).withColumn("p_value", mcnemar_p(F.col("recovered"), F.col("degraded")))


def _draw(seed: int, rep: Column, i: Column, n: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), i.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % n


def bootstrap_gain(rows: DataFrame, delta: Column, reps: int = 10_000, seed: int = 2026) -> DataFrame:
    """AG6, AG7: percentile interval of the mean of `delta` (in percent points) over resampled rows.

    Resampled rows matter by how often each distinct value of delta is drawn, so a replicate draws these counts at once
    from their multinomial distribution, by its own stream of the seed: its cost is that of the distinct values (three,
    or one a class), whatever the number of rows. No rows give null limits.
    """
    from tarsus.runtime import ship

    ship(rows.sparkSession)
    counts = rows.where(delta.isNotNull()).groupBy(delta.cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("_v"), F.sum("n").alias("_n"), F.sum(F.col("d") * F.col("n")).alias("_sum"))  # one entry a distinct value

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gains = []
            for rep, d, n in zip(b["rep"], b["_d"], b["_c"]):
                n = np.asarray(n, np.int64)
                drawn = np.random.default_rng([seed, int(rep)]).multinomial(n.sum(), n / n.sum())
                gains.append(100.0 * float(drawn @ np.asarray(d, float)) / n.sum())
            yield pd.DataFrame({"gain": gains})

    values = table.where("_n > 0").select(F.transform("_v", lambda v: v["d"]).alias("_d"), F.transform("_v", lambda v: v["n"]).alias("_c"))
    gains = rows.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(values)).mapInPandas(draw, "gain double")
    limits = gains.agg(F.percentile("gain", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    point = table.select(F.coalesce("_n", F.lit(0)).alias("total"), (100.0 * F.col("_sum") / F.col("_n")).alias("gain_pp"))
    return point.crossJoin(limits).select("total", "gain_pp", F.get("_q", F.lit(0)).alias("ci_lower_pp"), F.get("_q", F.lit(1)).alias("ci_upper_pp"), F.lit(reps).alias("reps"))


def hashed_bootstrap_gain(rows: DataFrame, delta: Column, reps: int = 10_000, seed: int = 2026, chunk: int = 16_384) -> DataFrame:
    """The same by draws that every engine repeats, a hash a row and replicate: percentile interval of the mean of `delta` (in percent points) over resampled rows.

    Rows matter by their values only, so they are laid out in the order of their values and kept as cumulative counts
    of the distinct ones: three for accuracy deltas, one a class for class means. Draws come from hashes of (seed,
    replicate, place), so every engine draws alike; each replicate is cut into chunks of draws that are summed apart.
    """
    counts = rows.groupBy(delta.cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("_v"), F.sum("n").alias("_n"))  # one entry a distinct value
    upper = F.aggregate("_v", F.array().cast("array<struct<d:double,u:bigint>>"), lambda s, v: F.concat(s, F.array(F.struct(v["d"].alias("d"), (F.coalesce(F.element_at(F.when(F.size(s) > 0, s), -1)["u"], F.lit(0)) + v["n"]).alias("u")))))
    table = table.select(upper.alias("_u"), "_n", F.aggregate("_v", F.lit(0.0), lambda s, v: s + v["d"] * v["n"]).alias("_sum"))
    chunks = rows.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(table))
    chunks = chunks.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / chunk)))).repartition("rep", "_c")
    places = F.sequence(F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col("_n")) - 1)
    drawn = F.aggregate(places, F.lit(0.0), lambda s, i: s + _value(F.col("_u"), _draw(seed, F.col("rep"), i, F.col("_n"))))
    gains = chunks.select("rep", "_n", drawn.alias("_s")).groupBy("rep", "_n").agg(F.sum("_s").alias("_s")).select((100.0 * F.col("_s") / F.col("_n")).alias("gain"))
    limits = gains.agg(F.percentile("gain", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    point = table.select(F.col("_n").alias("total"), (100.0 * F.col("_sum") / F.col("_n")).alias("gain_pp"))
    return point.crossJoin(limits).select("total", "gain_pp", F.get("_q", F.lit(0)).alias("ci_lower_pp"), F.get("_q", F.lit(1)).alias("ci_upper_pp"), F.lit(reps).alias("reps"))


def _value(table: Column, place: Column) -> Column:
    return F.get(F.filter(table, lambda t: place < t["u"]), F.lit(0))["d"]


def seed_interval(runs: DataFrame, metric: str) -> DataFrame:
    """AG8: mean, sample deviation and t interval over exactly three seeds; null limits for any other number."""
    n, half = F.count(metric), T_TWO_DF * F.stddev_samp(metric) / F.sqrt(F.lit(3.0))
    return runs.agg(n.alias("seeds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.when(n == 3, F.avg(metric) - half).alias("ci_lower"), F.when(n == 3, F.avg(metric) + half).alias("ci_upper"))


def gain_summary(runs: DataFrame, by: list[str], gain: str) -> DataFrame:
    """AG9: mean, deviation (null for one run), least and greatest gain, and whether all runs gained."""
    g = F.col(gain)
    return runs.groupBy(*by).agg(F.count(g).alias("runs"), F.avg(g).alias("mean_gain"), F.stddev_samp(g).alias("std_gain"), F.min(g).alias("min_gain"), F.max(g).alias("max_gain"), F.bool_and(g > 0).alias("all_gain"))


def inconsistent(rows: DataFrame) -> DataFrame:
    """AG33: comparisons whose recovered - degraded differs from the change in correct counts."""
    return rows.where(F.col("recovered") - F.col("degraded") != F.col("after_correct") - F.col("before_correct"))


def best_so_far(history: DataFrame, by: list[str], step: str, score: str, patience: int) -> DataFrame:
    """WN10: the running best, the step it was first reached, and whether patience has run out."""
    w = W.partitionBy(*by).orderBy(step)
    upto, earlier = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.unboundedPreceding, -1)
    h = history.withColumn("best", F.max(score).over(upto)).withColumn("_before", F.max(score).over(earlier))
    first = F.when(F.col("_before").isNull() | (F.col(score) > F.col("_before")), F.col(step))
    h = h.withColumn("best_step", F.max(first).over(upto)).drop("_before")
    return h.withColumn("stopped", F.col(step) - F.col("best_step") >= patience)
