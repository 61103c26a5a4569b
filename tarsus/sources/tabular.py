"""Strict readers of line and table files: declared schemas, failures instead of guesses (SRC1-SRC9, SRC26-SRC30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINE = 65_536
POLICIES = ("strict", "skip", "report")
TAXA = "taxon_id string, scientific_name string, common_name string, taxonomy_source string, taxonomy_version string"
SAMPLES = "dataset_id string, source_sample_id string, source_split string, relative_path string, image_uri string, group_id string, raw_label string, taxon_id string, sha256 string, phash string, license string, author string, source string"
PREDICTIONS = (
    "sample_index bigint, image_id bigint, relative_path string, target_class_id int, baseline_top1_class_id int, baseline_topk_class_ids array<int>, after_top1_class_id int, "
    "after_ranked_class_ids array<int>, target_in_baseline_topk boolean, baseline_top1_correct boolean, after_top1_correct boolean"
)


def guarded(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """The rows; reading a broken one fails the query with the message, whatever columns are read.

    The check is a filter that every row passes or fails loudly, so that no pruning of columns takes it away.
    """
    fails = F.raise_error(F.lit(message)).cast("boolean")
    return df.where(F.when(F.coalesce(broken, F.lit(True)), fails).otherwise(F.lit(True)))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC1: JSON lines under a declared schema; a line that doesn't parse, or no line at all, fails."""
    return require_rows(spark.read.schema(schema).option("mode", "FAILFAST").json(path), path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC27, SRC28, JSN1, JSN2: rows with _problem, null for rows that are right.

    Problems: too long, unreadable (repeated keys count as such), other keys than declared, and values whose kind is
    not the declared one (no coercion: a number is not a boolean).
    """
    struct = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json(F.col("value"))
    keys = F.array_sort(F.json_object_keys("value"))
    parsed = lines.select(F.col("value").alias("_line"), v.alias("_v"), keys.alias("_keys"), F.from_json("value", struct).alias("_r"))
    kinds = {T.BooleanType: "BOOLEAN", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.StringType: "STRING"}
    wrong = F.lit(False)
    for f in struct.fields:
        if type(f.dataType) in kinds:
            wrong = wrong | (F.schema_of_variant(F.variant_get("_v", f"$.{f.name}", "variant")) != kinds[type(f.dataType)])
        else:
            wrong = wrong | F.col(f"_r.{f.name}").isNull()
    problem = (
        F.when(F.octet_length("_line") > MAX_LINE, "too long")
        .when(F.col("_v").isNull() | F.col("_keys").isNull(), "unreadable")
        .when(F.col("_keys") != F.array(*[F.lit(n) for n in sorted(struct.names)]), "keys")
        .when(F.coalesce(wrong, F.lit(True)), "kind")
    )
    return parsed.select("_r.*", problem.alias("_problem"))


def prediction_violations(rows: DataFrame) -> DataFrame:
    """SRC27: (sample_index, problem) of prediction rows that contradict themselves; has to be empty."""
    top, ranked = F.col("baseline_topk_class_ids"), F.col("after_ranked_class_ids")
    checks = [
        ("candidates repeat", F.size(F.array_distinct(top)) == F.size(top)),
        ("ranking leaves the candidates", F.array_sort(top) == F.array_sort(ranked)),
        ("first candidate", F.get(top, F.lit(0)) == F.col("baseline_top1_class_id")),
        ("first of ranking", F.get(ranked, F.lit(0)) == F.col("after_top1_class_id")),
        ("recall flag", F.array_contains(top, F.col("target_class_id")) == F.col("target_in_baseline_topk")),
        ("baseline flag", (F.col("baseline_top1_class_id") == F.col("target_class_id")) == F.col("baseline_top1_correct")),
        ("after flag", (F.col("after_top1_class_id") == F.col("target_class_id")) == F.col("after_top1_correct")),
    ]
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks]))
    own = rows.select("sample_index", F.explode(found).alias("problem"))
    twice = rows.groupBy("sample_index").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sample_index", F.lit("repeated index").alias("problem"))
    return own.unionByName(twice)


def indexed_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: lines `id value` as (id, value); a line without both fails. Repeated ids: manifest.repeated."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).try_cast("bigint").alias("id"), F.get(parts, F.lit(1)).alias("value"))
    return guarded(rows, F.col("id").isNull() | F.col("value").isNull(), "a line is not `id value`")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: lines `id NNN.Class_name` as (class_id from 0, name with blanks)."""
    rows = indexed_text(spark, path)
    name = F.regexp_extract("value", r"^\d+\.(.+)$", 1)
    out = rows.select((F.col("id") - 1).alias("class_id"), F.replace(name, F.lit("_"), F.lit(" ")).alias("name"))
    return guarded(out, F.col("name") == "", "a class is not NNN.Name")


def csv_table(spark: SparkSession, path: str, required: tuple[str, ...], exact: bool = False, sep: str = ",") -> DataFrame:
    """SRC4, SRC7: a CSV with header as strings; a byte order mark is no part of the first name. Required columns have
    to be there, and with `exact` no others."""
    df = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    missing, extra = set(required) - set(names), set(names) - set(required)
    if missing or (exact and extra):
        raise ValueError(f"{path}: missing columns {sorted(missing)}, unexpected {sorted(extra) if exact else []}")
    return df.toDF(*names)


def species_table(spark: SparkSession, path: str, group: str = "Aves", rank: str = "species") -> DataFrame:
    """SRC4, FIL4: the species of one group."""
    df = csv_table(spark, path, ("birdnet_id", "scientific_name", "common_name", "taxon_group", "record_type"))
    return df.where((F.col("taxon_group") == group) & (F.col("record_type") == rank))


def alias_ids(species: DataFrame, column: str, ids: str, semicolons: bool = True) -> DataFrame:
    """SRC5: (alias key, sorted ids) over a column of delimited aliases."""
    from tarsus.functions.text import aliases, ascii_key

    exploded = species.select(F.explode(aliases(F.col(column), semicolons)).alias("_a"), F.col(ids).alias("_id"))
    return exploded.groupBy(ascii_key(F.col("_a")).alias("alias")).agg(F.array_sort(F.collect_set("_id")).alias("ids"))  # ids of one alias


def frame_boxes(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (species_id, species, video_name, frame, bird, behavior, box) from a semicolon CSV whose last column holds
    a literal list of 6-tuples: four corners, behavior, bird."""
    df = csv_table(spark, path, ("species_id", "species", "video_name", "frame", "bounding_boxes"), exact=True, sep=";")
    text = F.translate("bounding_boxes", "()", "[]")
    boxes = F.from_json(text, "array<array<double>>")
    rows = df.select(F.col("species_id").cast("int").alias("species_id"), "species", "video_name", F.col("frame").cast("int").alias("frame"), boxes.alias("_b"))
    rows = guarded(rows, F.col("_b").isNull() | F.exists("_b", lambda b: F.size(b) != 6), "bounding_boxes is not a list of 6-tuples")
    return rows.select("species_id", "species", "video_name", "frame", F.explode("_b").alias("_x")).select(
        "species_id", "species", "video_name", "frame", F.slice("_x", 1, 4).alias("box"), F.get("_x", F.lit(4)).cast("int").alias("behavior"), F.get("_x", F.lit(5)).cast("int").alias("bird")
    )


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: (video_name, split) from a JSON object of name lists; a list may be empty."""
    df = spark.read.schema("train_set array<string>, val_set array<string>, test_set array<string>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    pairs = F.array(*[F.struct(F.lit(s).alias("split"), F.col(c).alias("names")) for s, c in (("train", "train_set"), ("validation", "val_set"), ("test", "test_set"))])
    return df.select(F.explode(pairs).alias("_p")).select(F.explode("_p.names").alias("video_name"), F.col("_p.split").alias("split"))


def pair_prompts(spark: SparkSession, path: str) -> DataFrame:
    """SRC26: (first_id, second_id, descriptions), first below second."""
    schema = "first_id int, second_id int, descriptions array<struct<attribute:string,first:string,second:string>>"
    return guarded(jsonl(spark, path, schema), ~(F.col("first_id") < F.col("second_id")) | (F.size("descriptions") < 1), "a pair is out of order or without descriptions")


def missing_pairs(pairs: DataFrame, classes: int) -> DataFrame:
    """SRC26: unordered class pairs that have no descriptions. Pairs of classes are counted from the ids alone."""
    ids = pairs.sparkSession.range(classes).select(F.col("id").cast("int").alias("first_id"))
    every = ids.withColumn("second_id", F.explode(F.sequence(F.col("first_id") + 1, F.lit(classes)))).where(F.col("second_id") < classes)
    return every.join(pairs.select("first_id", "second_id"), ["first_id", "second_id"], "left_anti")


def pair_problems(pairs: DataFrame, classes: int) -> DataFrame:
    """SRC26: (first_id, second_id, problem): pairs of the classes that have no descriptions, and pairs of no class."""
    missing = missing_pairs(pairs, classes).select("first_id", "second_id", F.lit("missing").alias("problem"))
    extra = pairs.where((F.col("first_id") < 0) | (F.col("second_id") >= classes)).select("first_id", "second_id", F.lit("extra").alias("problem"))
    return missing.unionByName(extra)


def clip_problems(clips: DataFrame, species: DataFrame, behaviors: DataFrame) -> DataFrame:
    """SRC8: (clip, problem) of clips that name a species or behavior the dimensions don't have, or hold no frame.

    A null name is unknown, null frames are empty; a clip may have several problems.
    """
    def unknown(names: DataFrame, column: str, problem: str) -> DataFrame:
        return clips.join(names.select(column), column, "left_anti").select("clip", F.lit(problem).alias("problem"))

    frames = F.col("first_frame").try_cast("bigint") <= F.col("last_frame").try_cast("bigint")
    empty = clips.where(~F.coalesce(frames, F.lit(False))).select("clip", F.lit("empty").alias("problem"))
    return unknown(species, "species", "unknown species").unionByName(unknown(behaviors, "behavior", "unknown behavior")).unionByName(empty)


def only_match(spark: SparkSession, pattern: str) -> str:
    """SRC29: the one path that a pattern matches, on whatever file system the pattern names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = [str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]
    if len(found) != 1:
        raise ValueError(f"{pattern} matches {len(found)} paths")
    return found[0]


def source_configs(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """SRC30, VAL6, VAL8: enabled and disabled source rows; keys, unique ids, at least one enabled, the reading policy
    and the number of workers, 0 to 8, are checked."""
    keys = {"dataset_id", "path", "enabled", "policy", "workers"}
    for r in rows:
        if not {"dataset_id", "path"} <= set(r) <= keys:
            raise ValueError(f"a source row has the keys {sorted(r)}")
        if r.get("policy", "strict") not in POLICIES or type(r.get("workers", 0)) is not int or not 0 <= r.get("workers", 0) <= 8:
            raise ValueError(f"source {r['dataset_id']}: policy {r.get('policy')!r}, workers {r.get('workers')!r}")
    if len({r["dataset_id"] for r in rows}) != len(rows):
        raise ValueError("a dataset id is repeated")
    on = [r for r in rows if r.get("enabled", True)]
    if not on:
        raise ValueError("no source is enabled")
    return on, [r for r in rows if not r.get("enabled", True)]
