"""Embedding evaluation: zero-shot scoring, reranking, paired statistics and failure-set comparison.

The embeddings stand for image features. Class prototypes are normalized means over a hash-selected half (`fit`), and
every image is scored. The second system reranks an image's first three classes against pair prototypes: class a against
class b is the mean of those fit rows of a whose hash bucket is (a + b) mod 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.functions.vectors import cross_entropy, doubles, stable_share
from tarsus.operators import compare, paired, ranking, study
from tarsus.plans.registry import Registry
from tarsus.runtime import materialize, table

R = Registry()
K = 3

PROTO = """
fit AS (SELECT vec_id, label, embedding FROM embeddings WHERE ('0x' || substr(sha256('fit|' || vec_id), 1, 8))::BIGINT % 2 = 0),
means AS (SELECT label AS class_id, p AS pos, avg(embedding[p]::DOUBLE) AS m FROM fit, range(1, 65) t(p) GROUP BY ALL),
packed AS (SELECT class_id, list(m ORDER BY pos) AS v FROM means GROUP BY class_id),
proto AS (SELECT class_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS prototype FROM packed)
"""
SCORED = (
    PROTO
    + """,
scored AS (SELECT e.vec_id, e.label, p.class_id, list_dot_product(e.embedding::DOUBLE[], p.prototype) AS score FROM embeddings e, proto p),
ranks AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class_id) AS rank FROM scored)
"""
)
RERANKED = (
    SCORED
    + f""",
bucketed AS (SELECT *, ('0x' || substr(sha256('pair|' || vec_id), 1, 8))::BIGINT % 2 AS bucket FROM fit),
pmeans AS (SELECT label AS class_id, bucket, p AS pos, avg(embedding[p]::DOUBLE) AS m FROM bucketed, range(1, 65) t(p) GROUP BY ALL),
ppacked AS (SELECT class_id, bucket, list(m ORDER BY pos) AS v FROM pmeans GROUP BY ALL),
pproto AS (SELECT class_id, bucket, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS prototype FROM ppacked),
cand AS (SELECT vec_id, class_id, rank AS position FROM ranks WHERE rank <= {K}),
pairs AS (SELECT a.vec_id, a.class_id, a.position, p.prototype FROM cand a JOIN cand b ON a.vec_id = b.vec_id AND a.class_id <> b.class_id JOIN pproto p ON p.class_id = a.class_id AND p.bucket = (a.class_id + b.class_id) % 2),
pooled AS (SELECT vec_id, class_id, position, d, avg(prototype[d]) AS m FROM pairs, range(1, 65) t(d) GROUP BY ALL),
pv AS (SELECT vec_id, class_id, position, list(m ORDER BY d) AS v FROM pooled GROUP BY ALL),
rescored AS (SELECT q.vec_id, q.class_id, q.position, list_dot_product(e.embedding::DOUBLE[], q.v) / sqrt(list_dot_product(q.v, q.v)) AS score FROM pv q JOIN embeddings e USING (vec_id)),
reranks AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, position) AS rank FROM rescored),
outcomes AS (SELECT e.vec_id, e.label, b.class_id AS before_class, a.class_id AS after_class, b.class_id = e.label AS before, a.class_id = e.label AS after,
  EXISTS (SELECT 1 FROM cand c WHERE c.vec_id = e.vec_id AND c.class_id = e.label) AS in_topk
  FROM embeddings e JOIN ranks b ON b.vec_id = e.vec_id AND b.rank = 1 JOIN reranks a ON a.vec_id = e.vec_id AND a.rank = 1)
"""
)


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def prototypes(spark: SparkSession, d: str) -> DataFrame:
    fit = images(spark, d).where(ranking.fit_half(F.col("vec_id")))
    return ranking.mean_vectors(fit.withColumnRenamed("label", "class_id"), ["class_id"], "embedding")


def arrays(spark: SparkSession, d: str) -> DataFrame:
    return ranking.score_arrays(images(spark, d), prototypes(spark, d))


def rankings(spark: SparkSession, d: str) -> DataFrame:
    return ranking.exploded(arrays(spark, d))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_classes(arrays(spark, d).select("vec_id", "label", "ranked"), K, "candidates")


def reranked(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    fit = images(spark, d).where(ranking.fit_half(F.col("vec_id"))).withColumn("bucket", stable_share(F.col("vec_id"), "pair") % 2)
    protos = ranking.mean_vectors(fit.withColumnRenamed("label", "class_id"), ["class_id", "bucket"], "embedding")
    others = protos.select(F.col("class_id").alias("other")).distinct()
    pairs = protos.crossJoin(F.broadcast(others)).where((F.col("class_id") != F.col("other")) & ((F.col("class_id") + F.col("other")) % 2 == F.col("bucket")))  # class by class
    return ranking.rerank(images(spark, d), (candidates(spark, d) if base is None else base).select("vec_id", "candidates"), pairs.select("class_id", "other", "prototype"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """One row an image: both systems' first class, whether right, and whether the target is a candidate."""
    base = materialize(candidates(spark, d))
    after = reranked(spark, d, base).where("rank = 1").select("vec_id", F.col("class_id").alias("after_class"))
    before = F.get("candidates", F.lit(0))
    j = base.join(after, "vec_id")
    return j.select("vec_id", "label", before.alias("before_class"), "after_class", (before == F.col("label")).alias("before"), (F.col("after_class") == F.col("label")).alias("after"), F.array_contains("candidates", F.col("label")).alias("in_topk"))


@R.query("WITH " + PROTO + "SELECT class_id, i AS pos, round(prototype[i], 9) AS x FROM proto, range(1, 65) t(i)")
def pooled_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """AG12, MTH1: normalized class means."""
    return prototypes(spark, d).select("class_id", F.posexplode("prototype").alias("p", "x")).select("class_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("x", 9).alias("x"))


@R.query("WITH " + SCORED + "SELECT vec_id, class_id, round(score, 9) AS score, rank FROM ranks")
def full_ranking(spark: SparkSession, d: str) -> DataFrame:
    """JN11, MTH2, WN1, VAL11: all scores and the stable ranking."""
    return rankings(spark, d).select("vec_id", "class_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@R.query("WITH " + SCORED + "SELECT count(*) AS total, count(*) FILTER (rank <= 1) AS top1_correct, 100.0 * count(*) FILTER (rank <= 1) / count(*) AS top1, count(*) FILTER (rank <= 5) AS top5_correct, 100.0 * count(*) FILTER (rank <= 5) / count(*) AS top5 FROM ranks WHERE class_id = label")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """AG1."""
    return ranking.topk_accuracy(rankings(spark, d))


@R.query("WITH " + SCORED + f"SELECT vec_id, list(class_id ORDER BY rank)::VARCHAR AS candidates FROM ranks WHERE rank <= {K} GROUP BY vec_id")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """TK1, TK2."""
    return candidates(spark, d).select("vec_id", F.concat(F.lit("["), F.array_join(F.col("candidates").cast("array<string>"), ", "), F.lit("]")).alias("candidates"))


@R.query("WITH " + SCORED + "SELECT vec_id, min(rank) FILTER (class_id = label) <= 1 AS hit1, min(rank) FILTER (class_id = label) <= 5 AS hit5, min(rank) FILTER (class_id = label) AS target_rank FROM ranks GROUP BY vec_id")
def hit_mask(spark: SparkSession, d: str) -> DataFrame:
    """AG2, WN9, ARR1."""
    r = ranking.first_classes(arrays(spark, d).select("vec_id", "label", "ranked"), 10)
    return r.select("vec_id", ranking.hit(F.col("ranking"), F.col("label"), 1).alias("hit1"), ranking.hit(F.col("ranking"), F.col("label"), 5).alias("hit5"), ranking.target_rank(F.col("ranking"), F.col("label")).cast("bigint").alias("target_rank"))


@R.query("WITH " + SCORED + "SELECT label, round(100 * avg((rank = 1)::INT::DOUBLE), 9) AS accuracy FROM ranks WHERE class_id = label GROUP BY label")
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """AG3."""
    own = rankings(spark, d).where("class_id = label")
    return own.groupBy("label").agg(F.round(ranking.percentage(F.col("rank") == 1), 9).alias("accuracy"))


@R.query("WITH " + RERANKED + "SELECT vec_id, class_id, round(score, 9) AS score, rank FROM reranks")
def rerank_scores(spark: SparkSession, d: str) -> DataFrame:
    """JN12, JN13, JN14, TK5: candidates rescored against pooled pair prototypes."""
    return reranked(spark, d).select("vec_id", "class_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@R.query("WITH " + SCORED + f", cand AS (SELECT * FROM ranks WHERE rank <= {K}) SELECT least(a.class_id, b.class_id) AS first_id, greatest(a.class_id, b.class_id) AS second_id, count(*) AS images FROM cand a JOIN cand b ON a.vec_id = b.vec_id AND a.class_id < b.class_id GROUP BY ALL")
def required_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN13, SET7: the unordered class pairs that the candidates need."""
    p = ranking.candidate_pairs(candidates(spark, d)).where("class_id < other")
    return p.groupBy(F.col("class_id").alias("first_id"), F.col("other").alias("second_id")).agg(F.count(F.lit(1)).alias("images"))


@R.query("WITH " + RERANKED + "SELECT * FROM outcomes")
def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1, PRJ2 inputs: both systems' outcomes."""
    return outcomes(spark, d)


_CAT = "CASE WHEN before AND after THEN 'both_correct' WHEN after THEN 'recovered' WHEN before THEN 'degraded' ELSE 'both_wrong' END"
_COUNTS = "count(*) FILTER (before AND after) AS both_correct, count(*) FILTER (NOT before AND after) AS recovered, count(*) FILTER (before AND NOT after) AS degraded, count(*) FILTER (NOT before AND NOT after) AS both_wrong"


@R.query("WITH " + RERANKED + f"SELECT count(*) AS total, {_COUNTS}, 100.0 * count(*) FILTER (before AND after) / count(*) AS both_correct_percent, 100.0 * count(*) FILTER (NOT before AND after) / count(*) AS recovered_percent, 100.0 * count(*) FILTER (before AND NOT after) / count(*) AS degraded_percent, 100.0 * count(*) FILTER (NOT before AND NOT after) / count(*) AS both_wrong_percent FROM outcomes")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG4."""
    return paired.transitions(outcomes(spark, d), "before", "after")


@R.query(
    "WITH "
    + RERANKED
    + """, c AS (SELECT count(*) AS total, count(*) FILTER (NOT before AND after) AS recovered, count(*) FILTER (before AND NOT after) AS degraded FROM outcomes)
SELECT total, recovered, degraded, recovered + degraded AS discordant, CASE WHEN recovered + degraded = 0 THEN 1.0::DOUBLE ELSE round(least(1.0, (SELECT 2 * sum(exp(lgamma(recovered + degraded + 1) - lgamma(i + 1) - lgamma(recovered + degraded - i + 1) - (recovered + degraded) * ln(2.0))) FROM range(0, least(recovered, degraded) + 1) t(i))), 9) END AS p_value FROM c"""
)
def mcnemar_test(spark: SparkSession, d: str) -> DataFrame:
    """AG5."""
    return paired.mcnemar(outcomes(spark, d), "before", "after").withColumn("p_value", F.round("p_value", 9))


def _delta() -> Column:
    return (F.col("after").cast("int") - F.col("before").cast("int")).cast("double")


def _interval(b: DataFrame) -> DataFrame:
    return b.select(F.col("total").cast("bigint").alias("total"), *[F.round(c, 9).alias(c) for c in ("gain_pp", "ci_lower_pp", "ci_upper_pp")], "reps")


def _class_deltas(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("label").agg(F.avg(_delta()).alias("d"))


@R.query()
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """AG6, MTH6: 10,000 replicates of multinomial counts; paired_bootstrap_full has draws that SQL repeats."""
    return _interval(paired.bootstrap_gain(outcomes(spark, d), _delta()))


@R.query()
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """AG7: classes are resampled, not images; 10,000 replicates of multinomial counts."""
    return _interval(paired.bootstrap_gain(_class_deltas(spark, d), F.col("d")))


@R.query(
    "WITH "
    + RERANKED
    + """, o AS (SELECT row_number() OVER (ORDER BY after::INT - before::INT) - 1 AS i, (after::INT - before::INT)::DOUBLE AS d, count(*) OVER () AS n FROM outcomes),
draws AS (SELECT r AS rep, ('0x' || substr(sha256('2026|' || r || '|' || i), 1, 8))::BIGINT % n AS i FROM o, range(10000) t(r)),
gains AS (SELECT rep, 100.0 * sum(o.d) / any_value(n) AS gain FROM draws JOIN o USING (i) GROUP BY rep)
SELECT (SELECT count(*) FROM o) AS total, round((SELECT 100.0 * sum(d) / count(*) FROM o), 9) AS gain_pp, round(quantile_cont(gain, 0.025), 9) AS ci_lower_pp, round(quantile_cont(gain, 0.975), 9) AS ci_upper_pp, 10000 AS reps FROM gains"""
)
def paired_bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    """AG6, MTH6: 10,000 replicates by hashed draws."""
    return _interval(paired.hashed_bootstrap_gain(outcomes(spark, d), _delta()))


@R.query(
    "WITH "
    + RERANKED
    + """, o AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, d, count(*) OVER () AS n FROM (SELECT label, avg((after::INT - before::INT)::DOUBLE) AS d FROM outcomes GROUP BY label)),
draws AS (SELECT r AS rep, ('0x' || substr(sha256('2026|' || r || '|' || i), 1, 8))::BIGINT % n AS i FROM o, range(10000) t(r)),
gains AS (SELECT rep, 100.0 * sum(o.d) / any_value(n) AS gain FROM draws JOIN o USING (i) GROUP BY rep)
SELECT (SELECT count(*) FROM o) AS total, round((SELECT 100.0 * sum(d) / count(*) FROM o), 9) AS gain_pp, round(quantile_cont(gain, 0.025), 9) AS ci_lower_pp, round(quantile_cont(gain, 0.975), 9) AS ci_upper_pp, 10000 AS reps FROM gains"""
)
def cluster_bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    """AG7: 10,000 replicates by hashed draws."""
    return _interval(paired.hashed_bootstrap_gain(_class_deltas(spark, d), F.col("d")))


@R.query(
    "WITH "
    + RERANKED
    + f""", c AS (SELECT count(*) AS total, {_COUNTS} FROM outcomes)
SELECT *, recovered + degraded AS discordant, round(100.0 * (recovered - degraded) / total, 9) AS gain_pp, 10000 AS reps, true AS inside FROM c"""
)
def comparison_bundle(spark: SparkSession, d: str) -> DataFrame:
    """VAL13: one comparison in one row; the interval is held to lie around the gain."""
    c = study.comparison(outcomes(spark, d), "before", "after")
    inside = (F.col("ci_lower_pp") <= F.col("gain_pp")) & (F.col("gain_pp") <= F.col("ci_upper_pp"))
    return c.select("total", *paired.CATEGORIES, "discordant", F.round("gain_pp", 9).alias("gain_pp"), "reps", inside.alias("inside"))


@R.query(
    "WITH "
    + RERANKED
    + f"""SELECT count(*) AS total, {_COUNTS}, 100.0 * count(*) FILTER (in_topk) / count(*) AS candidate_recall,
100.0 * count(*) FILTER (before AND NOT after) / nullif(count(*) FILTER (before), 0) AS degraded_of_correct, 100.0 * count(*) FILTER (NOT before AND after) / nullif(count(*) FILTER (NOT before), 0) AS recovered_of_wrong FROM outcomes"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG18, AG22."""
    return compare.run_summary(outcomes(spark, d), "before", "after", "in_topk")


def _second_run(spark: SparkSession, d: str) -> DataFrame:
    """Another pair of systems over the same images: right by a hash, so that runs can be compared."""
    e = images(spark, d)
    return e.select("vec_id", "label", (stable_share(F.col("vec_id"), "run-b-before") % 10 < 6).alias("before"), (stable_share(F.col("vec_id"), "run-b-after") % 10 < 7).alias("after"))


RUNS = (
    RERANKED
    + f""",
second AS (SELECT vec_id, label, ('0x' || substr(sha256('run-b-before|' || vec_id), 1, 8))::BIGINT % 10 < 6 AS before, ('0x' || substr(sha256('run-b-after|' || vec_id), 1, 8))::BIGINT % 10 < 7 AS after FROM embeddings),
cats AS (SELECT a.vec_id, a.label, a.before AS before_a, a.after AS after_a, b.before AS before_b, b.after AS after_b, a.cat AS category_a, b.cat AS category_b FROM (SELECT *, {_CAT} AS cat FROM outcomes) a JOIN (SELECT *, {_CAT} AS cat FROM second) b ON a.vec_id = b.vec_id AND a.label = b.label),
names(category) AS (VALUES ('both_correct'), ('recovered'), ('degraded'), ('both_wrong'))
"""
)


def joined(spark: SparkSession, d: str) -> DataFrame:
    j = compare.joined_runs(outcomes(spark, d).select("vec_id", "label", "before", "after"), _second_run(spark, d), "vec_id", ("label",))
    return j.withColumn("category_a", paired.category(F.col("before_a"), F.col("after_a"))).withColumn("category_b", paired.category(F.col("before_b"), F.col("after_b")))


@R.query("WITH " + RUNS + "SELECT n.category, " + ", ".join(f"count(*) FILTER (c.category_b = '{c}') AS {c}" for c in paired.CATEGORIES) + " FROM names n LEFT JOIN cats c ON c.category_a = n.category GROUP BY n.category")
def compare_transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    """JN4, AG19: the flagship: failure sets of two runs, category by category."""
    return compare.transition_matrix(joined(spark, d), "category_a", "category_b")


@R.query(
    "WITH "
    + RUNS
    + """SELECT category, count(*) FILTER (category_a = category AND category_b = category) AS both, count(*) FILTER (category_a = category AND category_b <> category) AS only_a,
count(*) FILTER (category_b = category AND category_a <> category) AS only_b, 100.0 * count(*) FILTER (category_a = category AND category_b = category) / nullif(count(*) FILTER (category_a = category OR category_b = category), 0) AS jaccard_percent
FROM names, cats GROUP BY category"""
)
def compare_overlap(spark: SparkSession, d: str) -> DataFrame:
    """AG20, SET1."""
    return compare.overlap(joined(spark, d), "category_a", "category_b")


@R.query("WITH " + RUNS + "SELECT count(*) FILTER (NOT before_a AND NOT after_a AND NOT before_b AND NOT after_b) AS all_wrong, count(*) FILTER (NOT before_a AND NOT after_a) AS both_wrong_a, count(*) FILTER (NOT before_b AND NOT after_b) AS both_wrong_b FROM cats")
def compare_wrong_counters(spark: SparkSession, d: str) -> DataFrame:
    """AG21."""
    return compare.wrong_counters(joined(spark, d), ["before_a", "after_a", "before_b", "after_b"])


@R.query("WITH " + RUNS + "SELECT label, count(*) AS samples, min(vec_id) AS first_seen FROM (SELECT label_a AS label, vec_id FROM (SELECT label AS label_a, vec_id, category_b FROM cats) WHERE category_b = 'both_wrong') GROUP BY label ORDER BY samples DESC, first_seen LIMIT 12")
def most_common_failures(spark: SparkSession, d: str) -> DataFrame:
    """TK3: a top-12 report."""
    return compare.most_common(joined(spark, d).where("category_b = 'both_wrong'").withColumnRenamed("label_a", "label"), "label", "vec_id")


@R.query("WITH " + RUNS + "SELECT vec_id FROM cats WHERE category_a = 'both_correct' EXCEPT SELECT vec_id FROM cats WHERE category_b = 'both_correct'")
def failure_difference(spark: SparkSession, d: str) -> DataFrame:
    """SET1: samples that the first run alone has right twice."""
    j = joined(spark, d)
    return j.where("category_a = 'both_correct'").select("vec_id").subtract(j.where("category_b = 'both_correct'").select("vec_id"))


@R.query(
    """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'only in a' WHEN vec_id % 11 = 0 THEN 'identity' END AS problem FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0
UNION ALL SELECT -vec_id - 1, 'only in b' FROM embeddings WHERE vec_id % 13 = 0"""
)
def run_identity_violations(spark: SparkSession, d: str) -> DataFrame:
    """JN1, JN4, VAL12: a run against one that lacks samples, has others, and labels some otherwise."""
    a = outcomes(spark, d).select("vec_id", "label")
    other = a.where("vec_id % 7 <> 0").withColumn("label", F.when(F.col("vec_id") % 11 == 0, F.col("label") + 1).otherwise(F.col("label")))
    more = a.where("vec_id % 13 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), "label")
    return compare.run_mismatches(a, other.unionByName(more), "vec_id", ("label",))


_SEEDS = """
runs AS (SELECT s AS seed, 100.0 * avg((('0x' || substr(sha256('seed-' || s || '|' || vec_id), 1, 8))::BIGINT % 100 < 60)::INT::DOUBLE) AS top1, 100.0 * avg((('0x' || substr(sha256('base|' || vec_id), 1, 8))::BIGINT % 100 < 58)::INT::DOUBLE) AS base FROM embeddings, range(2026, 2029) t(s) GROUP BY s)
"""


def _seed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three seeds' accuracies and the baseline's, from hashed outcomes."""
    e = images(spark, d).select("vec_id", F.explode(F.sequence(F.lit(2026), F.lit(2028))).alias("seed"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit("seed-"), F.col("seed").cast("string"), F.lit("|"), F.col("vec_id").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return e.groupBy(F.col("seed").cast("bigint").alias("seed")).agg(ranking.percentage(drawn % 100 < 60).alias("top1"), ranking.percentage(stable_share(F.col("vec_id"), "base") % 100 < 58).alias("base"))


@R.query("WITH " + _SEEDS + "SELECT count(*) AS seeds, round(avg(top1), 9) AS mean, round(stddev_samp(top1), 9) AS std, round(avg(top1) - 4.302652729911275 * stddev_samp(top1) / sqrt(3.0), 9) AS ci_lower, round(avg(top1) + 4.302652729911275 * stddev_samp(top1) / sqrt(3.0), 9) AS ci_upper FROM runs")
def seed_interval(spark: SparkSession, d: str) -> DataFrame:
    """AG8."""
    return paired.seed_interval(_seed_runs(spark, d), "top1").select("seeds", *[F.round(c, 9).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")])


@R.query("WITH " + _SEEDS + "SELECT 'all' AS study, count(*) AS runs, round(avg(top1 - base), 9) AS mean_gain, round(stddev_samp(top1 - base), 9) AS std_gain, round(min(top1 - base), 9) AS min_gain, round(max(top1 - base), 9) AS max_gain, bool_and(top1 > base) AS all_gain FROM runs")
def seed_gains(spark: SparkSession, d: str) -> DataFrame:
    """AG9, AG32."""
    r = _seed_runs(spark, d).select(F.lit("all").alias("study"), (F.col("top1") - F.col("base")).alias("gain"))
    g = paired.gain_summary(r, ["study"], "gain")
    return g.select("study", "runs", *[F.round(c, 9).alias(c) for c in ("mean_gain", "std_gain", "min_gain", "max_gain")], "all_gain")


_TASKS = """
, logits AS (SELECT vec_id, label, vec_id % 4 AS task, list(20 * score ORDER BY class_id) AS l, min(rank) FILTER (class_id = label) = 1 AS correct, any_value(20 * score) FILTER (class_id = label) AS own FROM ranks GROUP BY vec_id, label),
rows_ AS (SELECT *, list_max(l) + ln(list_sum([exp(x - list_max(l)) FOR x IN l])) - own AS ce FROM logits)
"""


def _task_rows(spark: SparkSession, d: str) -> DataFrame:
    r = arrays(spark, d).withColumn("_i", F.array_position(F.transform("ranked", lambda s: s["class_id"]), F.col("label")))
    logits = F.transform("ranked", lambda s: 20 * s["score"])
    return r.select((F.col("vec_id") % 4).alias("task"), "vec_id", "label", (F.col("_i") == 1).alias("correct"), cross_entropy(logits, (F.col("_i") - 1).cast("int")).alias("ce"))


@R.query("WITH " + SCORED + _TASKS + "SELECT task, count(*) AS classes, round(100 * avg(a), 6) AS macro_accuracy, round(avg(c), 6) AS macro_loss FROM (SELECT task, label, avg(correct::INT::DOUBLE) AS a, avg(ce) AS c FROM rows_ GROUP BY task, label) GROUP BY task")
def class_balanced_tasks(spark: SparkSession, d: str) -> DataFrame:
    """AG10, MTH4."""
    t = ranking.class_balanced(_task_rows(spark, d), "task", "label", "correct", "ce")
    return t.select("task", "classes", F.round("macro_accuracy", 6).alias("macro_accuracy"), F.round("macro_loss", 6).alias("macro_loss"))


@R.query("WITH " + SCORED + _TASKS + "SELECT count(*) AS tasks, round(avg(m), 6) AS macro_accuracy, round(avg(l), 6) AS macro_loss FROM (SELECT task, 100 * avg(a) AS m, avg(c) AS l FROM (SELECT task, label, avg(correct::INT::DOUBLE) AS a, avg(ce) AS c FROM rows_ GROUP BY task, label) GROUP BY task)")
def macro_over_tasks(spark: SparkSession, d: str) -> DataFrame:
    """AG11."""
    t = ranking.macro(ranking.class_balanced(_task_rows(spark, d), "task", "label", "correct", "ce"), "macro_accuracy", "macro_loss")
    return t.select("tasks", F.round("macro_accuracy", 6).alias("macro_accuracy"), F.round("macro_loss", 6).alias("macro_loss"))


@R.query("SELECT label, count(*) AS rows, round(sqrt(count(*)) / sum(sqrt(count(*))) OVER (), 9) AS weight FROM embeddings GROUP BY label")
def task_weights(spark: SparkSession, d: str) -> DataFrame:
    """MTH7."""
    return ranking.sqrt_weights(images(spark, d), "label").withColumn("weight", F.round("weight", 9))


@R.query("WITH " + SCORED + ", alphas(alpha) AS (VALUES (0.0::DOUBLE), (0.5), (1.0)), mixed AS (SELECT alpha, vec_id, label, class_id, score + alpha * (class_id % 3) * 0.05 AS score FROM scored, alphas), r AS (SELECT *, row_number() OVER (PARTITION BY alpha, vec_id ORDER BY score DESC, class_id) AS rank FROM mixed) SELECT alpha, count(*) FILTER (rank = 1) AS top1_correct FROM r WHERE class_id = label GROUP BY alpha")
def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    """VAL10, MTH3: base scores plus alpha times residual scores, for every alpha of a small grid."""
    grid = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "alpha double")
    s = ranking.scores(images(spark, d), prototypes(spark, d)).crossJoin(F.broadcast(grid)).withColumn("score", F.col("score") + F.col("alpha") * (F.col("class_id") % 3) * 0.05)
    rank = F.row_number().over(W.partitionBy("alpha", "vec_id").orderBy(F.desc("score"), "position"))
    return s.withColumn("rank", rank).where("class_id = label").groupBy("alpha").agg(F.count_if(F.col("rank") == 1).alias("top1_correct"))


@R.query("WITH " + SCORED + "SELECT count(*) FILTER (class_id <> 9) AS matched, count(*) FILTER (class_id = 9) AS unmatched, round(max(abs(score - (score + (vec_id % 5) * 1e-3::DOUBLE))) FILTER (class_id <> 9), 9) AS max_abs_diff FROM scored")
def score_parity(spark: SparkSession, d: str) -> DataFrame:
    """AG29, TRN3: in-place scores against a plain join of long rows, from which a class is left out and scores are moved."""
    a = ranking.scores(images(spark, d), prototypes(spark, d)).select("vec_id", "class_id", "score")
    long = images(spark, d).select("vec_id", F.posexplode(doubles(F.col("embedding"))).alias("p", "x"))
    w = prototypes(spark, d).where("class_id <> 9").select("class_id", F.posexplode("prototype").alias("p", "w"))
    b = long.join(w, "p").groupBy("vec_id", "class_id").agg((F.sum(F.col("x") * F.col("w")) + (F.col("vec_id") % 5) * 1e-3).alias("score"))
    return ranking.parity(a, b, ["vec_id", "class_id"]).select("matched", "unmatched", F.round("max_abs_diff", 9).alias("max_abs_diff"))


_FAULTS = """SELECT vector_id, len(features) = 64 AND len([x FOR x IN features IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AS fine, features, label FROM cached_features"""


@R.query(
    f"""WITH v AS ({_FAULTS}) SELECT 'finite' AS check, count(*) FILTER (coalesce(len([x FOR x IN features IF x IS NULL OR isnan(x) OR isinf(x)]) > 0, true)) AS violations FROM v
UNION ALL SELECT 'unit_norm', count(*) FILTER (NOT coalesce(fine, false) OR abs(sqrt(list_dot_product(CASE WHEN fine THEN features END::DOUBLE[], CASE WHEN fine THEN features END::DOUBLE[])) - 1) > 1e-3) FROM v
UNION ALL SELECT 'width', count(*) FILTER (coalesce(len(features) <> 64, true)) FROM v UNION ALL SELECT 'label', count(*) FILTER (coalesce(label < 0 OR label > 900, true)) FROM v"""
)
def feature_violations(spark: SparkSession, d: str) -> DataFrame:
    """MTH5, SRC24, VAL9: predicates that every cached vector has to meet, over a cache with vectors of every fault."""
    from tarsus.functions.vectors import all_finite, unit_norm

    v = F.col("features")
    whole = (F.size(v) == 64) & all_finite(v)
    return ranking.count_violations(table(spark, d, "cached_features"), finite=all_finite(v), unit_norm=F.when(whole, unit_norm(v)).otherwise(F.lit(False)), width=F.size(v) == 64, label=F.col("label").between(0, 900))


@R.query(
    "WITH "
    + SCORED
    + f""", arr AS (SELECT vec_id, list(class_id ORDER BY rank) FILTER (rank <= {K}) AS a, list(class_id ORDER BY class_id) FILTER (rank <= {K}) AS s FROM ranks GROUP BY vec_id),
b AS (SELECT vec_id, a, CASE WHEN vec_id % 5 = 0 THEN [s[1], s[2], 99] ELSE s END AS b FROM arr)
SELECT vec_id, a = b AS equal, list_sort(a) = list_sort(b) AS same_classes, CASE WHEN a[1] <> b[1] THEN 1 WHEN a[2] <> b[2] THEN 2 WHEN a[3] <> b[3] THEN 3 END::BIGINT AS first_difference FROM b"""
)
def ranking_changes(spark: SparkSession, d: str) -> DataFrame:
    """VAL14, VAL17, ARR2: rankings against the classes in the order of their ids, of which some have another class."""
    a = candidates(spark, d).select("vec_id", F.col("candidates").alias("r"))
    s = F.array_sort("r")
    b = a.select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.concat(F.slice(s, 1, 2), F.array(F.lit(99).cast(a.schema["r"].dataType.elementType)))).otherwise(s).alias("r"))
    return compare.ranking_changes(a, b, "vec_id", "r").withColumn("first_difference", F.col("first_difference").cast("bigint"))


@R.query(
    "WITH "
    + RERANKED
    + """, s AS (SELECT label, count(*) FILTER (NOT before AND after) AS recovered, count(*) FILTER (before AND NOT after) AS degraded, count(*) FILTER (before) AS before_correct, count(*) FILTER (after) + (label % 4 = 3)::INT AS after_correct FROM outcomes GROUP BY label)
SELECT label, recovered, degraded, before_correct, after_correct FROM s WHERE recovered - degraded <> after_correct - before_correct"""
)
def comparison_consistency(spark: SparkSession, d: str) -> DataFrame:
    """AG30, AG33: comparisons whose counts contradict each other, one a class, some of which were miscounted."""
    after = F.count_if("after") + (F.first("label") % 4 == 3).cast("int")
    s = outcomes(spark, d).groupBy("label").agg(F.count_if(~F.col("before") & F.col("after")).alias("recovered"), F.count_if(F.col("before") & ~F.col("after")).alias("degraded"), F.count_if("before").alias("before_correct"), after.alias("after_correct"))
    return paired.inconsistent(s)


@R.query("WITH " + SCORED + "SELECT vec_id, round(min(score) FILTER (class_id = label) - max(score) FILTER (class_id <> label), 9) AS margin, min(rank) FILTER (class_id = label) AS target_rank FROM ranks GROUP BY vec_id")
def target_margins(spark: SparkSession, d: str) -> DataFrame:
    """PRJ8: the target's margin and rank."""
    a = arrays(spark, d)
    place = F.array_position(F.transform("ranked", lambda s: s["class_id"]), F.col("label")).cast("bigint")
    return a.select("vec_id", F.round(study.target_margin(F.col("ranked"), F.col("label")), 9).alias("margin"), place.alias("target_rank"))


@R.query(
    """WITH t AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'width' WHEN vec_id % 9 = 1 THEN 'repeated' WHEN vec_id % 9 = 2 THEN 'unknown class' WHEN vec_id % 9 = 3 THEN 'names' END AS p FROM embeddings)
SELECT vec_id, p AS problem FROM t WHERE p IS NOT NULL UNION ALL SELECT vec_id, 'names' FROM t WHERE p = 'unknown class'"""
)
def top_row_problems(spark: SparkSession, d: str) -> DataFrame:
    """VAL20: rows of predictions with every fault."""
    classes = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    fault = F.col("vec_id") % 9
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("label") + i) % 25).cast("int"))
    ids = F.when(fault == 0, F.slice(ids, 1, 4)).when(fault == 1, F.concat(F.slice(ids, 1, 4), F.slice(ids, 1, 1))).when(fault == 2, F.concat(F.slice(ids, 1, 4), F.array(F.lit(77)))).otherwise(ids)
    known = classes.agg(F.map_from_entries(F.collect_list(F.struct(F.col("class_id").cast("int"), "name"))).alias("_m"))
    rows = images(spark, d).select("vec_id", "label", ids.alias("top")).crossJoin(F.broadcast(known))
    names = F.transform("top", lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("?")))
    rows = rows.select("vec_id", "top", F.when(fault == 3, F.reverse(names)).otherwise(names).alias("names"))
    return study.top_problems(rows, "vec_id", "top", "names", classes)


@R.query("WITH o AS (SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS c FROM embeddings GROUP BY label) SELECT label, CASE label % 4 WHEN 1 THEN 'percent' WHEN 2 THEN 'counts' WHEN 3 THEN 'finite' END AS problem FROM o WHERE label % 4 <> 0 UNION ALL SELECT label, 'percent' FROM o WHERE label % 4 IN (2, 3)")
def metric_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """VAL25: accuracies of every class, some of which don't follow from their counts."""
    m = images(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 3 == 0).alias("c"))
    p, k = 100.0 * F.col("c") / F.col("n"), F.col("label") % 4
    m = m.select("label", "n", F.when(k == 2, F.col("n") + 1).otherwise(F.col("c")).alias("c"), F.when(k == 1, p + 1e-9).when(k == 3, F.lit(float("nan"))).otherwise(p).alias("p"))
    return study.metric_problems(m, "label", "c", "n", "p")


@R.query("WITH " + PROTO + """, u AS (SELECT class_id, sha256(class_id || '|' || list_aggregate([round(x * 1000000)::BIGINT::VARCHAR FOR x IN prototype], 'string_agg', ',')) AS h, substr(sha256(class_id::VARCHAR), 1, 3) AS bucket FROM proto),
b AS (SELECT bucket, sha256(string_agg(h, chr(10) ORDER BY class_id)) AS h, count(*) AS n FROM u GROUP BY bucket) SELECT 'all' AS run, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest, sum(n)::BIGINT AS rows FROM b""")
def prototype_digest(spark: SparkSession, d: str) -> DataFrame:
    """AG27: one digest of all prototypes."""
    return study.vector_digest(prototypes(spark, d).withColumn("run", F.lit("all")), ["run"], "class_id", "prototype")


@R.query(
    """WITH h AS (SELECT label AS trial, vec_id AS step, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings),
b AS (SELECT *, max(score) OVER w AS best, max(score) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h WINDOW w AS (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, max(CASE WHEN before IS NULL OR score > before THEN step END) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_step FROM b)
SELECT trial, step, score, best, best_step, step - best_step >= 50 AS stopped FROM s"""
)
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """WN10."""
    h = images(spark, d).select(F.col("label").alias("trial"), F.col("vec_id").alias("step"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score"))
    return paired.best_so_far(h, ["trial"], "step", "score", 50)


@R.query(
    """WITH t AS (SELECT label AS lr, vec_id % 3 AS wd, round(100 * avg((embedding[1] > 0)::INT::DOUBLE), 9) AS top1, round(100 * avg((embedding[2] > 0)::INT::DOUBLE), 9) AS top5, round(avg(abs(embedding[3]::DOUBLE)), 9) AS ce FROM embeddings GROUP BY ALL)
SELECT * FROM t ORDER BY top1 DESC, top5 DESC, ce, lr, wd LIMIT 1"""
)
def grid_argmax(spark: SparkSession, d: str) -> DataFrame:
    """WN11: the trial that is best by (top1, top5, -loss), the first of equals. The limit is the feature."""
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    t = images(spark, d).groupBy(F.col("label").alias("lr"), (F.col("vec_id") % 3).alias("wd")).agg(
        F.round(ranking.percentage(x(0) > 0), 9).alias("top1"), F.round(ranking.percentage(x(1) > 0), 9).alias("top5"), F.round(F.avg(F.abs(x(2))), 9).alias("ce")
    )
    return t.orderBy(F.desc("top1"), F.desc("top5"), "ce", "lr", "wd").limit(1)
