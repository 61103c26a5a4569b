import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarsus.operators import manifest
from tarsus.plans import files
from tarsus.sources import archives, features, sinks, tabular
from tarsus.streaming import shards


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_jsonl(spark, tmp_path):
    good = put(tmp_path, "a.jsonl", '{"taxon_id":"t","scientific_name":"A b"}\n')
    assert tabular.jsonl(spark, good, tabular.TAXA).count() == 1
    with pytest.raises(ValueError):
        tabular.jsonl(spark, put(tmp_path, "b.jsonl", ""), tabular.TAXA)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        tabular.jsonl(spark, put(tmp_path, "c.jsonl", "{broken\n"), tabular.TAXA)


def test_strict_jsonl(spark, tmp_path):
    lines = ['{"i":1,"ok":true}', '{"i":1,"ok":1}', '{"i":1}', '{"i":1,"ok":true,"i":2}', '{"i":true,"ok":true}', "nonsense", json.dumps({"i": 1, "ok": True, "x": 2})]
    got = tabular.strict_jsonl(spark, put(tmp_path, "s.jsonl", "\n".join(lines)), "i bigint, ok boolean").collect()
    assert [r._problem for r in got] == [None, "kind", "keys", "unreadable", "kind", "unreadable", "keys"]


def test_prediction_violations(spark, rows):
    good = (0, 1, "p", 2, 1, [1, 2], 2, [2, 1], True, False, True)
    bad = (1, 1, "p", 2, 1, [1, 1], 2, [2, 3], True, True, True)
    df = spark.createDataFrame([good, bad, bad], tabular.PREDICTIONS)
    assert {r[0] for r in rows(tabular.prediction_violations(df))} == {1}
    assert (1, "repeated index") in rows(tabular.prediction_violations(df))


def test_indexed_text_and_classes(spark, tmp_path, rows):
    assert rows(tabular.indexed_text(spark, put(tmp_path, "i.txt", "1 a b\n2 c\n"))) == [(1, "a b"), (2, "c")]
    assert rows(tabular.class_names(spark, put(tmp_path, "c.txt", "1 001.Black_bird\n"))) == [(0, "Black bird")]
    broken = tabular.indexed_text(spark, put(tmp_path, "j.txt", "only\n"))
    unnamed = tabular.class_names(spark, put(tmp_path, "k.txt", "1 Bird\n"))
    for read in (broken, broken.select("value"), broken.select(F.lit(1)), unnamed.select("name"), unnamed.select("class_id")):
        with pytest.raises(PySparkException):
            read.collect()
    for read in (broken, unnamed):
        with pytest.raises(PySparkException):
            read.count()


def test_csv(spark, tmp_path, rows):
    path = put(tmp_path, "s.csv", "﻿birdnet_id,scientific_name,common_name,taxon_group,record_type\nB1,A a,X,Aves,species\nB2,B b,Y,Insecta,species\n")
    assert tabular.species_table(spark, path).count() == 1
    with pytest.raises(ValueError):
        tabular.csv_table(spark, path, ("birdnet_id",), exact=True)
    with pytest.raises(ValueError):
        tabular.csv_table(spark, path, ("absent",))
    a = spark.createDataFrame([("B1", "Blue|Azure;Sky"), ("B2", "azure")], "id string, al string")
    assert rows(tabular.alias_ids(a, "al", "id")) == [("azure", ["B1", "B2"]), ("blue", ["B1"]), ("sky", ["B1"])]


def test_frame_boxes_and_stride(spark, tmp_path):
    text = "species_id;species;video_name;frame;bounding_boxes\n1;x;v;0;[(1, 2, 3, 4, 5, 6)]\n1;x;v;1;[(1, 2, 3, 4, 5, 6)]\n1;x;v;10;[(1, 2, 3, 4, 5, 6), (1, 2, 3, 4, 5, 7)]\n1;x;v;407;[(1, 2, 3, 4, 5, 6)]\n"
    b = tabular.frame_boxes(spark, put(tmp_path, "b.csv", text))
    kept = b.where(F.col("frame") % 10 == 0)
    assert b.count() == 5 and kept.count() == 3 and kept.select("video_name", "frame").distinct().count() == 2
    with pytest.raises(PySparkException):
        tabular.frame_boxes(spark, put(tmp_path, "c.csv", text + "1;x;v;9;[(1, 2)]\n")).collect()


def test_split_lists_and_pairs(spark, tmp_path, rows):
    got = tabular.split_lists(spark, put(tmp_path, "s.json", '{"train_set":["a"],"val_set":[],"test_set":["b","c"]}'))
    assert rows(got) == [("a", "train"), ("b", "test"), ("c", "test")]
    d = [{"attribute": "x", "first": "f", "second": "s"}]
    p = tabular.pair_prompts(spark, put(tmp_path, "p.jsonl", "\n".join(json.dumps({"first_id": a, "second_id": b, "descriptions": d}) for a, b in ((0, 1), (0, 2)))))
    assert rows(tabular.missing_pairs(p, 3)) == [(1, 2)]


def test_globs_and_configs(spark, tmp_path):
    put(tmp_path, "x1.txt", "")
    assert tabular.only_match(spark, str(tmp_path / "x*.txt")).endswith("x1.txt")
    put(tmp_path, "x2.txt", "")
    with pytest.raises(ValueError):
        tabular.only_match(spark, str(tmp_path / "x*.txt"))
    on, off = tabular.source_configs([{"dataset_id": "a", "path": "p"}, {"dataset_id": "b", "path": "p", "enabled": False}])
    assert len(on) == 1 and len(off) == 1
    for bad in ([{"dataset_id": "a"}], [{"dataset_id": "a", "path": "p", "enabled": False}], [{"dataset_id": "a", "path": "p"}] * 2, [{"dataset_id": "a", "path": "p", "workers": 9}], [{"dataset_id": "a", "path": "p", "workers": True}], [{"dataset_id": "a", "path": "p", "policy": "x"}]):
        with pytest.raises(ValueError):
            tabular.source_configs(bad)


def test_coco_plan(spark, tmp_path):
    doc = {
        "images": [{"id": str(i), "file_name": f"{i}.jpg", "width": 6, "height": 6} for i in range(3)],
        "annotations": [{"id": "a", "image_id": "0", "category_id": 1, "bbox": [-0.5, 2, 4, 5.5]}, {"id": "b", "image_id": "1", "category_id": 2, "bbox": [0, 0, 1, 1]}, {"id": "c", "image_id": "2", "category_id": 0, "bbox": [0, 0, 1, 1]}],
        "categories": [{"id": 0, "name": "empty"}, {"id": 1, "name": "Genus species"}, {"id": 2, "name": "bird"}],
    }
    images, annotations, categories = archives.coco(spark, put(tmp_path, "c.json", json.dumps(doc)))
    got = archives.coco_plan(images, annotations, categories).collect()
    assert [(r.id, r.box, r.changed) for r in got] == [("a", [0.0, 2.0, 3.5, 6.0], True)]
    assert manifest.unknown_keys(annotations.select(F.col("image_id").alias("k")), images.select(F.col("id").alias("k")), "k").isEmpty()


def test_document_is_cut_between_elements():
    doc = {"info": {"a": ["x", {"b": 1}]}, "images": [{"id": '7"],}\\\\', "é": [[1, {"z": "]"}], "\\\\"]}, None, 3], "none": [], "no": None, 'k"[': [[1], []], "annotations": [{"id": str(i)} for i in range(40)]}
    for text in (json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False)):
        for size in (1, 2, 3, 7, 50, 10_000):
            got = {}
            for name, part in archives.array_parts(io.BytesIO(text.encode()), size):
                assert len(part.encode()) <= 2 * size + 120  # one element more than what is read at once
                got.setdefault(name, []).extend(json.loads(part))
            assert got == {k: v for k, v in doc.items() if isinstance(v, list) and v}
    for bad in ('{"a": [1,2', '{"a": [1,]}', '{"a": [,1]}', '{"a": [1}', '{"a" [1]}', '{"a": [1]} {}', "[[1]]", '{"a": [1], "a": [2]}', ""):
        for size in (1, 4, 99):
            with pytest.raises(ValueError):
                for _, part in archives.array_parts(io.BytesIO(bad.encode()), size):
                    json.loads(part)


def test_coco_documents_of_several_tasks(spark, tmp_path):
    """No task holds a document: it is written from several and read as parts."""
    few = spark.range(5000, numPartitions=6).where("id % 5000 >= 900").select(F.col("id").cast("string"), F.concat(F.lit('a"],{\\'), "id").alias("file_name"), F.lit(6).alias("width"), F.lit(6).alias("height"))
    path = files.document(spark, {"images": few, "annotations": spark.createDataFrame([], "id string"), "categories": spark.range(2).select("id", F.lit("é").alias("name"))})
    images, annotations, categories = archives.coco(spark, path)
    assert images.exceptAll(few).isEmpty() and images.count() == 4100 and annotations.isEmpty() and categories.count() == 2
    with gzip.open(path.removeprefix("file://")) as f:
        assert len(json.load(f)["images"]) == 4100
    bad = put(tmp_path, "bad.json", '{"images": [{"id": "1", "width": "wide"}]}')
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        archives.coco(spark, bad)[0].collect()


def test_coco_crops_collect_no_array(spark, tmp_path):
    """The document of the plans is made and planned without a list of all rows in one task."""
    spark.range(300).selectExpr("id AS c_custkey", "'c' || id AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4000, numPartitions=5).selectExpr("id AS o_orderkey", "id % 300 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(25).selectExpr("id AS n_nationkey", "'N' || id AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    seen, agg = [], type(spark.range(1)).agg
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "agg", lambda self, *c: (seen.extend(map(str, c)), agg(self, *c))[1])
        got = files.coco_crops(spark, str(tmp_path)).collect()
    assert not [c for c in seen if "collect_list" in c]
    x, y = (lambda k: k % 360 - 20), (lambda k: k % 230 - 10)
    want = [k for k in range(4000) if k % 25 not in (3, 4) and x(k) < 320 and y(k) < 200 + k % 300 % 40]
    assert sorted(int(r.id) for r in got) == want


def test_coco_parts_are_small_and_read_one_by_one(spark, tmp_path):
    """What a task holds of a document doesn't follow the document: parts are small, and none are read or written in
    pages or batches of parts."""
    images = [{"id": str(i), "file_name": f"{i}\u001e\né".rjust(90, "x"), "width": 6, "height": i} for i in range(20_000)]
    text = json.dumps({"images": images, "other": [1] * 9, "annotations": [{"id": "a"}], "categories": []})
    parts = [part for _, part in archives.array_parts(io.BytesIO(text.encode()))]
    assert len(text) > 2_000_000 and max(map(len, parts)) < 200_000
    tables = archives.coco(spark, put(tmp_path, "c.json", text))
    assert [t.count() for t in tables] == [20_000, 1, 0]
    assert sorted((r.height, r.id, r.file_name) for r in tables[0].collect()) == [(i["height"], i["id"], i["file_name"]) for i in images]
    assert not any("Batched: true" in t._jdf.queryExecution().toString() for t in tables)
    for bad in ('{"images": [{"id": "1\x1e2"}]}', '{"images": [{"id": "1"}\x1e, {"id": "2"}]}', '{"images": [{"id": "1"}, {"id": "2"}\x1e]}'):
        with pytest.raises(Exception, match="(?i)malformed|cannot"):
            archives.coco(spark, put(tmp_path, "bad.json", bad))[0].collect()


def test_archives(spark, tmp_path, rows):
    path = str(tmp_path / "z.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d/a.txt", "images/train/3/frame_1_2.png Mallard\n")
        z.writestr("d/b.png", b"x")
    expected = spark.createDataFrame([("d/a.txt",), ("d/c.png",)], "m string")
    assert rows(archives.member_problems(spark, path, expected, "m")) == [("d/b.png", "extra"), ("d/c.png", "missing")]
    lines = archives.annotation_lines(archives.zip_texts(spark, path)).collect()
    assert [tuple(r) for r in lines] == [("train", "3", "frame_1", 2, "Mallard")]
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        archives.zip_members(path)


def test_features(spark, tmp_path, rows):
    good, bad = [1.0, 0.0], [2.0, float("nan")]
    f = spark.createDataFrame([(0, good, 0), (1, bad, 5), (2, None, None)], "k bigint, v array<double>, label int")
    problems = rows(features.violations(f, "k", "v", "label", 2, 3))
    assert {(1, "not finite"), (1, "label")} <= set(problems) and {k for k, _ in problems} == {1, 2}
    path = str(tmp_path / "cache")
    assert features.write_missing(spark, f.select("k", "v"), path, "k", 1) == 3
    assert features.write_missing(spark, f.select("k", "v"), path, "k", 1) == 3
    texts = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    e = features.encode_texts(texts, "t", features.hashing_encoder(4)).collect()
    assert len(e) == 2 and all(abs(sum(x * x for x in r.features) - 1) < 1e-9 for r in e)


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(2, None), (1, "x")], "b int, a string")
    out = str(tmp_path / "out")
    sinks.write_jsonl(df, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    with pytest.raises(PySparkException):
        sinks.write_jsonl(df, out)
    with pytest.raises(ValueError):
        sinks.write_csv(df.where("b > 9"), str(tmp_path / "csv"))
    one, two = (sinks.write_predictions(d, str(tmp_path / n), "b") for d, n in ((df, "p1"), (df.orderBy("b"), "p2")))
    assert one == two and len(one) == 64
    files = tmp_path / "files"
    files.mkdir()
    (files / "a").write_text("x")
    recorded = spark.createDataFrame([("a", hashlib.sha256(b"y").hexdigest()), ("b", "0")], "name string, sha256 string")
    assert rows(sinks.checksum_problems(spark, str(files), recorded)) == [("a", "changed"), ("b", "missing")]
    sinks.write_bundle(str(tmp_path / "bundle"), {"x.md": sinks.markdown(df, ("b", "a"))})
    with pytest.raises(FileExistsError):
        sinks.write_bundle(str(tmp_path / "bundle"), {})
    assert (sinks.run_directory(str(tmp_path / "runs"), {"a": 1}) / "config.json").exists()


def test_resumable_ingestion(spark, tmp_path, rows):
    src, target, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    src.mkdir()
    (src / "s1.json").write_text('{"k":1}\n{"k":2}\n')
    shards.ingest(spark, str(src), "k int", target, check)
    (src / "s2.json").write_text('{"k":3}\n')
    for _ in range(2):
        shards.ingest(spark, str(src), "k int", target, check)
    assert rows(shards.shard_counts(spark, target)) == [("s1.json", 2), ("s2.json", 1)]
