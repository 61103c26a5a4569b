"""Scores, stable rankings, top-k metrics and candidate reranking (JN11-JN14, WN1, TK1-TK5, AG1-AG3, AG10-AG12, AG22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.functions.vectors import dot, doubles, l2_normalize, let, stable_share


def mean_vectors(rows: DataFrame, by: list[str], vector: str, out: str = "prototype") -> DataFrame:
    """AG12: the L2-normalized mean of each group's vectors: one partial aggregate a position, whatever the group's size."""
    long = rows.select(*by, F.posexplode(doubles(F.col(vector))).alias("_pos", "_x"))
    means = long.groupBy(*by, "_pos").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_v"))  # one entry a dimension
    return packed.select(*by, l2_normalize(F.transform("_v", lambda s: s["_m"])).alias(out))


def pool(vectors: Column) -> Column:
    """AG12 within a row: the normalized mean of a bounded array of vectors."""
    n = F.size(vectors)
    summed = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return let(summed, lambda total: l2_normalize(F.transform(total, lambda x: x / n)))


def scores(images: DataFrame, prototypes: DataFrame, image: str = "vec_id", vector: str = "embedding", cls: str = "class_id") -> DataFrame:
    """JN11: every image against every class prototype. The prototypes are one row a class; they are folded to a single
    array row first, so each image row is scored in place and nothing is paired by a shuffle."""
    table = prototypes.agg(F.array_sort(F.collect_list(F.struct(F.col(cls), F.col("prototype")))).alias("_protos"))  # as many as classes
    joined = images.crossJoin(F.broadcast(table))
    each = F.transform("_protos", lambda p: F.struct(p[cls].alias(cls), dot(F.col(vector), p["prototype"]).alias("score")))
    return joined.select(*[c for c in images.columns if c != vector], F.posexplode(each).alias("position", "_s")).select("*", "_s.*").drop("_s")


def score_arrays(images: DataFrame, prototypes: DataFrame, vector: str = "embedding", cls: str = "class_id") -> DataFrame:
    """JN11, WN1 without a shuffle: an image's row with `ranked`, its classes by descending score, ties by their place
    in the class table: (score, position, class)."""
    table = prototypes.agg(F.array_sort(F.collect_list(F.struct(F.col(cls), F.col("prototype")))).alias("_protos"))  # as many as classes
    each = F.transform("_protos", lambda p, i: F.struct((-dot(F.col(vector), p["prototype"])).alias("_down"), i.alias("position"), p[cls].alias(cls)))
    joined = images.crossJoin(F.broadcast(table)).withColumn("_s", F.array_sort(each))
    scored = F.transform("_s", lambda s: F.struct((-s["_down"]).alias("score"), s["position"].alias("position"), s[cls].alias(cls)))
    return joined.select(*[c for c in images.columns if c != vector], scored.alias("ranked"))


def exploded(arrays: DataFrame) -> DataFrame:
    """Long rows of `score_arrays`: a class each, with its rank from 1."""
    rest = [c for c in arrays.columns if c != "ranked"]
    return arrays.select(*rest, F.posexplode("ranked").alias("_r", "_s")).select(*rest, "_s.*", (F.col("_r") + 1).alias("rank"))


def first_classes(arrays: DataFrame, k: int, out: str = "ranking", cls: str = "class_id") -> DataFrame:
    """TK1, TK2 without a shuffle: the first k classes of every image."""
    return arrays.withColumn(out, F.transform(F.slice("ranked", 1, k), lambda s: s[cls])).drop("ranked")


def ranked(scored: DataFrame, image: str = "vec_id", score: str = "score", position: str = "position") -> DataFrame:
    """WN1 over long rows: rank from 1 by descending score, ties by the column position, never by the class id."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(image).orderBy(F.desc(score), position)))


def top_k(rankings: DataFrame, k: int) -> DataFrame:
    """TK1, TK2: the first k; the filter becomes a group limit below the window's sort."""
    return rankings.where(F.col("rank") <= k)


def ranking_arrays(rankings: DataFrame, keep: list[str], k: int, out: str = "ranking", cls: str = "class_id") -> DataFrame:
    """One row an image with the array of its first k classes."""
    best = top_k(rankings, k).groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("rank", cls))).alias("_r"))  # k entries
    return best.select(*keep, F.transform("_r", lambda r: r[cls]).alias(out))


def hit(ranking: Column, target: Column, k: int) -> Column:
    """AG2: whether the target is among the first k; k beyond the ranking's width is an error, not a shorter look."""
    guarded = F.when(F.size(ranking) >= k, ranking).otherwise(F.raise_error(F.lit(f"k = {k} exceeds the ranking's width")).cast("array<int>"))
    return F.array_contains(F.slice(guarded, 1, k), target)


def target_rank(ranking: Column, target: Column) -> Column:
    """WN9: place of the target from 1, null if absent."""
    return F.nullif(F.array_position(ranking, target), F.lit(0))


def topk_accuracy(rankings: DataFrame, ks: tuple[int, ...] = (1, 5), target: str = "label", cls: str = "class_id", image: str = "vec_id") -> DataFrame:
    """AG1: one row with total, and correct counts and percentages for each k."""
    own = rankings.where(F.col(cls) == F.col(target))
    n = F.count(F.lit(1))
    cols = [c for k in ks for c in (F.count_if(F.col("rank") <= k).alias(f"top{k}_correct"), (100.0 * F.count_if(F.col("rank") <= k) / n).alias(f"top{k}"))]
    return own.agg(n.alias("total"), *cols)


def percentage(flag: Column) -> Column:
    """AG3: mean of a flag in percent."""
    return 100.0 * F.avg(flag.cast("double"))


def class_balanced(rows: DataFrame, task: str, cls: str, correct: str, loss: str) -> DataFrame:
    """AG10: per task, the mean over classes of the class's accuracy and mean loss."""
    by_class = rows.groupBy(task, cls).agg(F.avg(F.col(correct).cast("double")).alias("_a"), F.avg(loss).alias("_l"))
    return by_class.groupBy(task).agg(F.count(F.lit(1)).alias("classes"), (100.0 * F.avg("_a")).alias("macro_accuracy"), F.avg("_l").alias("macro_loss"))


def macro(task_scores: DataFrame, *metrics: str) -> DataFrame:
    """AG11: tasks with equal weight."""
    return task_scores.agg(F.count(F.lit(1)).alias("tasks"), *[F.avg(m).alias(m) for m in metrics])


def sqrt_weights(rows: DataFrame, task: str) -> DataFrame:
    """MTH7: task weights in proportion to the square root of their rows."""
    n = rows.groupBy(task).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("weight", F.sqrt("rows") / F.sum(F.sqrt("rows")).over(W.partitionBy(F.lit(1))))


def candidate_pairs(candidates: DataFrame, image: str = "vec_id", cls: str = "class_id") -> DataFrame:
    """JN13: ordered pairs of an image's candidates, made within a row from its array of k candidates."""
    c = F.col("candidates")
    pairs = F.filter(F.flatten(F.transform(c, lambda a: F.transform(c, lambda b: F.struct(a.alias(cls), b.alias("other"))))), lambda p: p[cls] != p["other"])
    return candidates.select(image, F.explode(pairs).alias("_p")).select(image, "_p.*")


def rerank(images: DataFrame, candidates: DataFrame, pair_prototypes: DataFrame, image: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """JN12, JN14, TK5: an image's candidates scored against prototypes pooled from what tells each from the others.

    `candidates` has an array of class ids in baseline order, `pair_prototypes` (class_id, other, prototype) one row per
    ordered pair. The ranking keeps to the candidates; ties go by their baseline order. The pair table is deduplicated
    and joined by key, so only the pairs that some image needs are read.
    """
    wanted = candidate_pairs(candidates, image)
    joined = wanted.join(pair_prototypes, ["class_id", "other"])
    pooled = joined.groupBy(image, "class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "prototype"))), lambda s: s["prototype"]).alias("_ps"))  # k - 1 vectors
    scored = pooled.select(image, "class_id", pool(F.col("_ps")).alias("_p")).join(images.select(image, vector), image)
    scored = scored.join(candidates, image).select(image, "class_id", dot(F.col(vector), F.col("_p")).alias("score"), F.array_position("candidates", F.col("class_id")).alias("position"))
    return ranked(scored, image)


def fit_half(key: Column, seed: str = "fit") -> Column:
    """A hash-selected half of all rows."""
    return stable_share(key, seed) % 2 == 0


def count_violations(df: DataFrame, **checks: Column) -> DataFrame:
    """(check, violations): how many rows break each predicate; null counts as broken."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    parts = [agg.select(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks]
    return reduce(DataFrame.unionByName, parts)


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """AG29: rows in common, rows in one only, and the largest absolute difference."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"))


