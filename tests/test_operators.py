import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarsus.operators import compare, manifest, paired, partitions, ranking, resolve, training


def test_stable_ranking(spark, rows):
    logits = [[0.5, 0.5, -1.0], [-2.0, 3.0, 1.0]]
    df = spark.createDataFrame([(i, p, p, s) for i, r in enumerate(logits) for p, s in enumerate(r)], "vec_id int, position int, class_id int, score double")
    got = ranking.ranking_arrays(ranking.ranked(df), ["vec_id"], 3)
    assert rows(got) == [(0, [0, 1, 2]), (1, [1, 2, 0])]


def test_ties_go_by_position_not_class(spark, rows):
    df = spark.createDataFrame([(0, 0, 17, -1.0), (0, 1, 4, 3.0), (0, 2, 99, 2.0), (1, 0, 17, 5.0), (1, 1, 4, 5.0), (1, 2, 99, 0.0)], "vec_id int, position int, class_id int, score double")
    assert rows(ranking.ranking_arrays(ranking.ranked(df), ["vec_id"], 3)) == [(0, [4, 99, 17]), (1, [17, 4, 99])]


def test_hits(spark):
    df = spark.createDataFrame([([5, 1, 9], 1), ([0, 1, 2], 2), ([4, 3, 8], 7)], "r array<int>, t int")
    hits = lambda k: [r[0] for r in df.select(ranking.hit(F.col("r"), F.col("t"), k)).collect()]
    assert hits(1) == [False, False, False] and hits(2) == [True, False, False] and hits(3) == [True, True, False]
    with pytest.raises(PySparkException):
        hits(4)
    assert [r[0] for r in df.select(ranking.target_rank(F.col("r"), F.col("t"))).collect()] == [2, 3, None]


def test_pool_and_means(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "g int, v array<double>")
    assert ranking.mean_vectors(df, ["g"], "v").first()["prototype"] == pytest.approx([2**-0.5, 2**-0.5])
    packed = df.groupBy("g").agg(F.collect_list("v").alias("vs"))
    assert packed.select(ranking.pool(F.col("vs"))).first()[0] == pytest.approx([2**-0.5, 2**-0.5])


def test_rerank_keeps_to_candidates(spark, rows):
    images = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    cands = spark.createDataFrame([(1, [2, 0])], "vec_id int, candidates array<int>")
    protos = spark.createDataFrame([(2, 0, [0.0, 1.0]), (0, 2, [1.0, 0.0]), (7, 0, [1.0, 0.0])], "class_id int, other int, prototype array<double>")
    assert rows(ranking.rerank(images, cands, protos).select("class_id", "rank")) == [(0, 1), (2, 2)]


PAIRS = [(True, True), (False, True), (False, True), (True, False), (False, False)]


def test_transitions_and_mcnemar(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, before boolean, after boolean")
    t = paired.transitions(df, "before", "after").first()
    assert (t.both_correct, t.recovered, t.degraded, t.both_wrong, t.recovered_percent) == (1, 2, 1, 1, 40.0)
    assert paired.mcnemar(df, "before", "after").first().p_value == 1.0
    b = paired.bootstrap_gain(df, F.col("after").cast("int") - F.col("before").cast("int"), reps=200)
    first, again = b.first(), b.first()
    assert first == again and first.gain_pp == pytest.approx(20.0) and first.ci_lower_pp <= 20.0 <= first.ci_upper_pp


def test_bootstrap_takes_ten_thousand_replicates(spark):
    d = [-1.0, 0.0, 0.0, 1.0, 1.0]
    gains = [sum(d[int(hashlib.sha256(f"2026|{r}|{i}".encode()).hexdigest()[:8], 16) % 5] for i in range(5)) / 5 * 100 for r in range(10_000)]
    b = paired.bootstrap_gain(spark.createDataFrame([(x,) for x in d], "d double"), F.col("d")).first()
    assert b.reps == 10_000 and b.total == 5
    assert (b.ci_lower_pp, b.ci_upper_pp) == pytest.approx(tuple(np.percentile(gains, (2.5, 97.5))))


def test_bootstrap_chunks_draw_alike(spark):
    df = spark.createDataFrame([(i, float(i % 3 - 1)) for i in range(100)], "i int, d double")
    assert paired.hashed_bootstrap_gain(df, F.col("d"), 20, chunk=7).first() == paired.hashed_bootstrap_gain(df, F.col("d"), 20).first()


def test_seed_statistics(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", -1.0)], "k string, g double")
    s = paired.seed_interval(runs.where("k = 'a'"), "g").first()
    assert s.mean == 2.0 and s["ci_upper"] - 2.0 == pytest.approx(paired.T_TWO_DF / 3**0.5)
    g = {r.k: r for r in paired.gain_summary(runs, ["k"], "g").collect()}
    assert g["a"].all_gain and not g["b"].all_gain and g["b"].std_gain is None


def test_best_so_far(spark):
    h = spark.createDataFrame([("t", i, s) for i, s in enumerate([1.0, 3.0, 3.0, 2.0, 2.5])], "k string, step int, s double")
    got = [(r.best, r.best_step, r.stopped) for r in paired.best_so_far(h, ["k"], "step", "s", 3).orderBy("step").collect()]
    assert got == [(1.0, 0, False), (3.0, 1, False), (3.0, 1, False), (3.0, 1, False), (3.0, 1, True)]


def test_compare_runs(spark, rows):
    a = spark.createDataFrame([(1, 0, "both_wrong"), (2, 0, "recovered")], "k int, label int, c string")
    b = spark.createDataFrame([(1, 0, "both_wrong"), (2, 1, "degraded"), (3, 0, "degraded")], "k int, label int, c string")
    assert rows(compare.run_mismatches(a, b, "k", ("label",))) == [(2, "identity"), (3, "only in b")]
    j = compare.joined_runs(a, b, "k", ("label",))
    m = {r.category: r for r in compare.transition_matrix(j, "c_a", "c_b").collect()}
    assert m["both_wrong"].both_wrong == 1 and sum(r[c] for r in m.values() for c in paired.CATEGORIES) == 1
    o = {r.category: r for r in compare.overlap(j, "c_a", "c_b").collect()}
    assert o["both_wrong"].jaccard_percent == 100.0 and o["degraded"].jaccard_percent is None


def test_most_common_breaks_ties_by_first(spark):
    df = spark.createDataFrame([(5, "b"), (1, "a"), (2, "b"), (3, "a")], "i int, v string")
    assert [tuple(r) for r in compare.most_common(df, "v", "i", 1).collect()] == [("a", 2, 1)]


def test_stratified_split_ignores_input_order(spark, rows):
    data = [(c, f"k{c}-{i}") for c in range(5) for i in range(10)]
    one = rows(partitions.stratified_split(spark.createDataFrame(data, "c int, k string"), "c", "k", 2, "2026"))
    two = rows(partitions.stratified_split(spark.createDataFrame(data[::-1], "c int, k string").repartition(3), "c", "k", 2, "2026"))
    assert one == two and sum(r[2] == "validation" for r in one) == 10


@pytest.mark.parametrize("n,fraction,validation", [(10, 0.2, 2), (5, 0.001, 1), (5, 0.999, 4), (5, 0.5, 2)])
def test_taxon_partition(spark, n, fraction, validation):
    t = spark.createDataFrame([(f"t{i}",) for i in range(n)], "t string")
    assert partitions.taxon_partition(t, "t", fraction, "s").where("part = 'validation'").count() == validation


def test_adjacent_split(spark):
    c = spark.createDataFrame([(i, f"n{i}") for i in range(200)], "id int, n string")
    got = partitions.adjacent_split(c, "id", "n", "salt").groupBy((F.col("id") / 2).cast("int"), "part").count()
    assert got.count() == 200 and got.agg(F.max("count")).first()[0] == 1


def test_refit_rows(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "i int, t string")
    b = spark.createDataFrame([(0, "b"), (1, "c"), (2, "b")], "i int, t string")
    dropped = spark.createDataFrame([("validation", 2)], "part string, i int")
    got = partitions.refit_rows([("train", a), ("validation", b)], "t", "i", dropped).orderBy("position").collect()
    assert [r.label for r in got] == [0, 1, 1, 2] and [r.part for r in got] == ["train"] * 2 + ["validation"] * 2


def test_duplicate_audit(spark):
    s = spark.createDataFrame(
        [("first", 0, "x", "t1", "train"), ("first", 1, "x", "t1", "test"), ("second", 0, "x", "t2", "train"), ("second", 1, "y", "t2", "train"), ("second", 2, None, "t2", "train")],
        "ds string, i int, sha string, taxon string, split string",
    )
    got = {(r.ds, r.i): r for r in manifest.duplicate_audit(s, "sha", "ds", ["ds", "i"], "taxon", F.col("split") == "train").collect()}
    assert {k for k, r in got.items() if r.drops} == {("second", 0)} and len(got) == 3
    assert all(r.canonical_dataset == "first" and r.taxon_conflict for r in got.values())


def test_near_pairs(spark, rows):
    s = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (7, "b"), (None, "a")], "h bigint, ds string")
    assert rows(manifest.near_pairs(s, "h", "ds", 1)) == [(0, 1, 1, 2, 1)]
    assert rows(manifest.near_pairs(s, "h", "ds", 0)) == []
    assert len(rows(manifest.near_pairs(s, "h", "ds", 3))) == 2


def test_coverage(spark):
    f = spark.createDataFrame([("v", i) for i in (0, 1, 10, 407)], "video string, frame int")
    n = spark.createDataFrame([("v", 470)], "video string, length int")
    r = manifest.coverage(f, "video", "frame", n, 10).first()
    assert (r.horizon, r.trailing, r.sampled, r.sampled_trailing) == (408, 62, 47, 6)


def test_compact_task(spark):
    r = spark.createDataFrame([(i, s, "cabd"[s]) for i, s in enumerate([3, 0, 2, 1, 3, 2])], "i int, s int, t string")
    excluded = spark.createDataFrame([("b",), ("c",)], "t string")
    got = manifest.compact_task(r, "s", "t", excluded).orderBy("i").collect()
    assert [x.i for x in got] == [0, 3, 4] and [x.task_label for x in got] == [1, 0, 1]


def test_content_digest_sees_order_and_values(spark):
    a = spark.createDataFrame([(1, "g", "x"), (2, "g", "y")], "k int, g string, v string")
    digest = lambda df: manifest.content_digest(df, ["g"], "k", F.col("v")).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("k")).repartition(2))
    assert digest(a) != digest(a.withColumn("v", F.when(F.col("k") == 1, "y").otherwise("x")))


def test_resolution(spark):
    taxa = spark.createDataFrame([("BN1", "alpha prima", "Blue Bird"), ("BN2", "beta secunda", "Red Bird"), ("BN3", "beta secunda", "Grey Bird")], "taxon_id string, s string, c string")
    labels = spark.createDataFrame([(1, "Alpha prima", "x"), (2, "nothing", "red bird"), (3, "beta secunda", "z")], "i int, s string, c string")
    from tarsus.functions.text import ascii_key

    k = lambda c: ascii_key(F.col(c))
    got = resolve.cascade(labels, k("s"), k("c"), F.concat(F.lit("own:"), F.col("i").cast("string")), taxa, k("s"), k("c"), "taxon_id").orderBy("i").collect()
    assert [r.resolved for r in got] == ["BN1", "BN2", "own:3"]
    assert [r.policy for r in resolve.crosswalk(labels, k("s"), taxa, k("s"), "taxon_id").orderBy("i").collect()] == ["unique", "missing", "ambiguous"]


def test_grid_search_separates(spark):
    rng = np.random.default_rng(0)
    data = [(int(c), (np.eye(5)[c] + rng.normal(0, 0.05, 5)).tolist(), "validation" if i < 3 else "fit") for c in range(5) for i in range(12)]
    df = spark.createDataFrame(data, "label int, embedding array<double>, part string")
    trials = spark.createDataFrame([(0.1, 0.0), (0.01, 0.01)], "rate double, decay double")
    got = training.grid_search(df, trials).orderBy(F.desc("rate")).first()
    assert got.total == 15 and got.top1_correct == 15
    few = training.grid_search(df, trials, rows_per_class=2, alphas=(0.0, 1.0)).collect()  # bounds the fit, never the scoring
    assert len(few) == 4 and {r.total for r in few} == {15} and {round(r.loss, 6) for r in few if r.alpha == 0} == {round(float(np.log(5)), 6)}
    based = df.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == (F.col("label") + 1) % 5).cast("double")))
    assert {r.top1_correct for r in training.grid_search(based, trials, alphas=(0.0,), base="scores").collect()} == {0}
    head = training.refit(df, 0.1, 0.0)
    logits = training.apply_head(df.withColumn("k", F.monotonically_increasing_id()), head, "k")
    assert logits.count() == 60 * 5


def test_adapter_scale_zero_is_identity(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0])], "k int, embedding array<double>")
    got = training.adapt(df, np.ones((2, 2)), np.ones((2, 2)), 0.0, "k").first().adapted
    assert got == pytest.approx([0.6, 0.8])
