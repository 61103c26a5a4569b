import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsus.operators import paired, partitions, study
from tarsus.sources import archives, tabular


def test_bootstrap_by_counts_agrees_with_plain_resampling(spark):
    rng = np.random.default_rng(1)
    d = rng.choice([-1.0, 0.0, 1.0], 400, p=[0.1, 0.6, 0.3])
    df = spark.createDataFrame([(float(x),) for x in d] + [(None,)], "d double")
    got = paired.bootstrap_gain(df, F.col("d"), 4000).first()
    plain = np.quantile([100 * rng.choice(d, 400).mean() for _ in range(4000)], [0.025, 0.975])
    assert got.total == 400 and got.gain_pp == pytest.approx(100 * d.mean()) and got.reps == 4000
    assert abs(got.ci_lower_pp - plain[0]) < 0.7 and abs(got.ci_upper_pp - plain[1]) < 0.7
    again = paired.bootstrap_gain(df.repartition(3), F.col("d"), 4000).first()
    assert again == got
    same = paired.bootstrap_gain(spark.createDataFrame([(0.25,)] * 5, "d double"), F.col("d"), 50).first()
    assert (same.ci_lower_pp, same.gain_pp, same.ci_upper_pp) == (25.0, 25.0, 25.0)
    none = paired.bootstrap_gain(df.limit(0), F.col("d"), 10).first()
    assert none.total == 0 and none.gain_pp is None and none.ci_lower_pp is None


def test_comparison_in_one_row(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, True), (True, False), (False, False)], "b boolean, a boolean")
    c = study.comparison(df, "b", "a", 200).first()
    assert (c.total, c.recovered, c.degraded, c.discordant, c.gain_pp) == (5, 2, 1, 3, 20.0) and c.p_value == 1.0 and c.ci_lower_pp <= 20 <= c.ci_upper_pp


def test_top_problems(spark, rows):
    classes = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "class_id int, name string")
    df = spark.createDataFrame([(1, [0, 1], ["n0", "n1"]), (2, [0, 0], ["n0", "n0"]), (3, [0, 9], ["n0", None]), (4, [0], ["n0"]), (5, [1, 0], ["n0", "n1"]), (6, None, None)], "k int, i array<int>, n array<string>")
    got = rows(study.top_problems(df, "k", "i", "n", classes, 2))
    assert got == [(2, "repeated"), (3, "unknown class"), (4, "width"), (5, "names"), (6, "names"), (6, "repeated"), (6, "unknown class"), (6, "width")] or {k for k, _ in got} == {2, 3, 4, 5, 6}
    assert (2, "repeated") in got and (3, "unknown class") in got and (4, "width") in got and (5, "names") in got


def test_config_and_embedded_problems(spark, rows):
    have = spark.createDataFrame([("r", "s", "a", "number", "1"), ("r", "s", "b", "text", "x"), ("r", "s", "seed", "number", "7"), ("r", "s", "d", "number", "1")], "run string, study string, field_path string, kind string, value string")
    want = spark.createDataFrame([("s", "a", "text", "1"), ("s", "b", "text", "y"), ("s", "c", "text", "z"), ("s", "seed", "number", "8")], "study string, field_path string, kind string, value string")
    assert rows(study.config_problems(have, want, "run", "study", ("seed",))) == [("r", "a", "kind"), ("r", "b", "value"), ("r", "c", "missing"), ("r", "d", "unexpected")]
    a, b = have.drop("study"), have.drop("study").where("field_path <> 'd'").withColumn("kind", F.when(F.col("field_path") == "a", "text").otherwise(F.col("kind")))
    assert rows(study.embedded_problems(a, b, "run")) == [("r", "a", "differs"), ("r", "d", "not embedded")]


def test_cells_metrics_and_lists(spark, rows):
    cells = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "seed int, trial string")
    runs = spark.createDataFrame([(1, "x", True), (1, "x", False), (2, "x", True), (2, "x", True)], "seed int, trial string, done boolean")
    assert rows(study.cell_problems(cells, runs, ["seed", "trial"], F.col("done"))) == [(1, "y", 0, "missing"), (2, "x", 2, "several")]
    m = spark.createDataFrame([("a", 1, 4, 25.0), ("b", 1, 4, 25.0001), ("c", 5, 4, 125.0), ("d", 0, 0, None)], "k string, c int, n int, p double")
    got = rows(study.metric_problems(m, "k", "c", "n", "p"))
    assert [g for g in got if g[0] != "d"] == [("b", "percent"), ("c", "counts")] and ("d", "finite") in got
    z = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["a"], ["a"]), (3, None, ["a"])], "k int, a array<string>, b array<string>")
    assert rows(study.zipped_problems(z, "k", "a", "b")) == [(1, 1, "b", None)]


def test_numbers_run_over_ranges(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(i), int(rng.integers(3))) for i in rng.permutation(500)], "i int, g int").repartition(5)
    got = partitions.numbered(df, "g", "i").orderBy("position").collect()
    assert [r.position for r in got] == list(range(500)) and [(r.g, r.i) for r in got] == sorted((r.g, r.i) for r in got)
    assert partitions.numbered(df.limit(0), "g", "i").count() == 0


def test_stratified_split_keeps_rows(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 10 else None, "clash") for i in range(60)], "k int, c int, _n string")
    got = partitions.stratified_split(df, "c", "k", 4, "s").collect()
    assert len(got) == 60 and got[0].asDict().keys() == {"k", "c", "_n", "part"}
    assert sum(r.part == "validation" for r in got) == 12 and all(r.part == "fit" for r in got if r.c is None)


def test_tar_member(spark, tmp_path, rows):
    doc = json.dumps({"categories": [{"id": 1, "supercategory": "Birds"}, {"id": 2, "supercategory": "x"}]}).encode()
    for name, member in (("a", "x/train.json"), ("b", "other.txt")):
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as t:
            info = tarfile.TarInfo(member)
            info.size = len(doc)
            t.addfile(info, io.BytesIO(doc))
    read = archives.tar_json(spark, str(tmp_path / "a.tar.gz"), "train.json", "categories array<struct<id:int,supercategory:string>>")
    cats = read.select(F.explode("categories").alias("c")).select("c.*")
    marks = spark.createDataFrame([(5, 1), (6, 2)], "image_id int, category_id int")
    kept, retained = archives.supercategory(cats, marks, "Birds")
    assert rows(kept) == [(1, "Birds")] and [r.image_id for r in retained.collect()] == [5]
    with pytest.raises(Exception, match="no member"):
        archives.tar_json(spark, str(tmp_path / "b.tar.gz"), "train.json", "categories array<struct<id:int>>").collect()


def test_clip_problems(spark, rows):
    clips = spark.createDataFrame([("a", "s", "1", "0", "5"), ("b", "t", "1", "6", "5"), ("c", None, "9", None, "5")], "clip string, species string, behavior string, first_frame string, last_frame string")
    got = rows(tabular.clip_problems(clips, spark.createDataFrame([("s",)], "species string"), spark.createDataFrame([("1",)], "behavior string")))
    assert got == [("b", "empty"), ("b", "unknown species"), ("c", "empty"), ("c", "unknown behavior"), ("c", "unknown species")]
