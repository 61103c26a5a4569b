"""Small heads on frozen features: grid search, refit, adapters (TRN1-TRN8, MTH8). One trial is one group of rows.

The features of a trial are what one worker trains on; they have to be a bounded sample (`rows_per_class`, a
parameter). Everything around the fit - splits, sampling, scoring, selection - is relational and covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.functions.vectors import combine, cross_entropy, dot
from tarsus.runtime import materialize, ship


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_head(x: np.ndarray, y: np.ndarray, classes: int, rate: float, decay: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """AdamW from zero weights (TRN4) on the whole batch; returns weights (classes, d) and biases."""
    w, b = np.zeros((classes, x.shape[1])), np.zeros(classes)
    onehot = np.eye(classes)[y]
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, epochs + 1):
        g = (softmax(x @ w.T + b) - onehot) / len(x)
        for k, (p, grad) in enumerate(((w, g.T @ x), (b, g.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            p *= 1 - rate * decay * (k == 0)
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, b


#: The grid of rates and decays, and the weights of the residual.
RATES, DECAYS, ALPHAS = (1e-3, 3e-3, 1e-2), (0.0, 1e-4, 1e-3, 1e-2), (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)


def trial_table(spark: SparkSession, rates: tuple[float, ...] = RATES, decays: tuple[float, ...] = DECAYS) -> DataFrame:
    return spark.createDataFrame([(r, w) for r in rates for w in decays], "rate double, decay double")


def bounded_rows(rows: DataFrame, label: str, vector: str, rows_per_class: int) -> DataFrame:
    """At most rows_per_class rows a class, by the hash order of their vectors: the sample a head may be fitted on."""
    w = W.partitionBy(label).orderBy(F.xxhash64(vector))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows_per_class).drop("_n")


def fit_trials(fit: DataFrame, trials: DataFrame, label: str, vector: str, epochs: int) -> DataFrame:
    """(rate, decay, class_id, weights, bias): a head a trial, each fitted by its own worker on the same bounded rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(k=[np.asarray(v).tobytes() for v in group["vector"]]).sort_values(["label", "k"])
        x, y = np.stack(group["vector"].to_numpy()).astype(float), group["label"].to_numpy(int)
        rate, decay = float(group["rate"].iloc[0]), float(group["decay"].iloc[0])
        weights, bias = fit_head(x, y, int(y.max()) + 1, rate, decay, epochs)
        return pd.DataFrame({"rate": rate, "decay": decay, "class_id": np.arange(len(bias)), "weights": list(weights), "bias": bias})

    rows = fit.select(F.col(label).alias("label"), F.col(vector).alias("vector")).crossJoin(F.broadcast(trials.select("rate", "decay")))
    return rows.groupBy("rate", "decay").applyInPandas(run, "rate double, decay double, class_id int, weights array<double>, bias double")


def grid_search(
    rows: DataFrame, trials: DataFrame, label: str = "label", vector: str = "embedding", part: str = "part", epochs: int = 200, rows_per_class: int = 512, alphas: tuple[float, ...] = (1.0,), base: str | None = None
) -> DataFrame:
    """TRN1: (rate, decay, alpha, total, top1_correct, loss) of every trial, scored on every validation row.

    rows: part fit or validation, label from 0. A head is fitted on at most rows_per_class fit rows a class; the bound
    touches no other row. Scores are base + alpha * head, where `base` names an array column of scores (zeros without
    one). Labels that no fit row has count as wrong and leave the loss null.
    """
    ship(rows.sparkSession)
    heads = materialize(fit_trials(bounded_rows(rows.where(F.col(part) == "fit"), label, vector, rows_per_class), trials, label, vector, epochs))
    packed = heads.groupBy("rate", "decay").agg(F.array_sort(F.collect_list(F.struct("class_id", "weights", "bias"))).alias("_h"))  # one entry a class
    asked = rows.where(F.col(part) == "validation").select(F.col(label).cast("int").alias("_y"), F.col(vector).alias("_v"), (F.col(base) if base else F.lit(None)).cast("array<double>").alias("_b"))
    head = asked.crossJoin(F.broadcast(packed)).withColumn("_s", F.transform("_h", lambda h: dot(F.col("_v"), h["weights"]) + h["bias"]))
    each = head.withColumn("alpha", F.explode(F.lit(list(alphas)))).withColumn("_s", F.when(F.col("_b").isNull(), F.transform("_s", lambda x: x * F.col("alpha"))).otherwise(combine(F.col("_b"), F.col("_s"), F.col("alpha"))))
    first = F.array_position("_s", F.array_max("_s")) - 1
    scored = each.select("rate", "decay", "alpha", (first == F.col("_y")).alias("_hit"), cross_entropy(F.col("_s"), F.col("_y")).alias("_loss"))
    return scored.groupBy("rate", "decay", "alpha").agg(F.count(F.lit(1)).alias("total"), F.count_if("_hit").alias("top1_correct"), F.avg("_loss").alias("loss"))


def refit(rows: DataFrame, rate: float, decay: float, label: str = "label", vector: str = "embedding", epochs: int = 60, rows_per_class: int = 512) -> DataFrame:
    """TRN2: weights of a head fitted on all parts: one row a class."""
    ship(rows.sparkSession)
    trial = rows.sparkSession.createDataFrame([(rate, decay)], "rate double, decay double")
    return fit_trials(bounded_rows(rows, label, vector, rows_per_class), trial, label, vector, epochs).select("class_id", "weights", "bias")


def apply_head(rows: DataFrame, head: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """TRN3: (key, class_id, logit) of every row under a head, whose classes travel as one broadcast row."""
    packed = head.agg(F.array_sort(F.collect_list(F.struct("class_id", "weights", "bias"))).alias("_h"))
    scored = F.transform("_h", lambda h: F.struct(h["class_id"].alias("class_id"), (dot(F.col(vector), h["weights"]) + h["bias"]).alias("logit")))
    return rows.crossJoin(F.broadcast(packed)).select(key, F.explode(scored).alias("_s")).select(key, "_s.*")


def _erf(x: np.ndarray) -> np.ndarray:
    from math import erf

    return np.vectorize(erf, otypes=[float])(x)


def adapt(rows: DataFrame, down: np.ndarray, up: np.ndarray, scale: float, key: str, vector: str = "embedding") -> DataFrame:
    """MTH8, TRN6: normalize(x + scale * up(GELU(down x))) for every row, weights broadcast; the exact GELU needs erf."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((np.asarray(down, float), np.asarray(up, float)))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        for batch in batches:
            if len(batch):
                x = np.stack(batch["_v"].to_numpy()).astype(float)
                h = x @ a.T
                h = 0.5 * h * (1 + _erf(h / np.sqrt(2.0)))
                out = x + scale * (h @ b.T)
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: batch[key], "adapted": list(out)})

    return rows.select(key, F.col(vector).alias("_v")).mapInPandas(run, f"`{key}` {kind}, adapted array<double>")


def membership(rows: DataFrame, task: str, key: str) -> DataFrame:
    """TRN8: per task its number of rows and a digest of its members."""
    from tarsus.operators.manifest import content_digest

    return content_digest(rows, [task], key, F.col(key).cast("string"))


def prepared_tasks(rows: DataFrame, dataset: str, split: str, taxon: str, validation_taxa: DataFrame, excluded: DataFrame) -> DataFrame:
    """TRN7: rows of each dataset by role: train rows of training taxa fit, validation rows of held-out taxa validate,
    and both refit; excluded taxa take no part, and a role with fewer than two taxa in a dataset is omitted."""
    kept = rows.where(F.col(taxon).isNotNull()).join(excluded.select(taxon), taxon, "left_anti")
    kept = kept.join(validation_taxa.select(taxon, F.lit(True).alias("_held")), taxon, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    roles = F.array_compact(F.array(F.when((F.col(split) == "train") & ~F.col("_held"), F.lit("fit")), F.when((F.col(split) == "validation") & F.col("_held"), F.lit("validation")), F.when(F.col(split).isin("train", "validation"), F.lit("refit"))))
    by_role = kept.withColumn("role", F.explode(roles)).drop("_held")
    taxa = by_role.groupBy(dataset, "role").agg(F.count_distinct(taxon).alias("_t")).where("_t >= 2")
    out = by_role.join(taxa, [dataset, "role"])
    labels = out.select(dataset, "role", taxon).distinct().withColumn("task_label", F.row_number().over(W.partitionBy(dataset, "role").orderBy(taxon)) - 1)
    return out.join(labels, [dataset, "role", taxon]).drop("_t")
