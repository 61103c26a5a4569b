"""Readers and sinks over files written from the test tables: written, read back, and held against the tables."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.functions.text import capitalized
from tarsus.operators import manifest
from tarsus.plans.registry import Registry
from tarsus.runtime import shared_dir, table
from tarsus.sources import archives, features, sinks, tabular
from tarsus.streaming import shards

R = Registry()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the session."""
    path = f"{shared_dir(spark)}/tarsus-files-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """One small file on whatever file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return path


def lines(spark: SparkSession, df: DataFrame, value: Column) -> str:
    path = folder(spark)
    df.select(value.alias("value")).write.text(path)
    return path


@R.query("SELECT taxon_id, scientific_name, common_name, taxonomy_source, taxonomy_version FROM taxa")
def jsonl_taxa(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, SNK1: taxa as JSON lines."""
    path = folder(spark)
    sinks.write_jsonl(table(spark, d, "taxa"), path)
    return tabular.jsonl(spark, path, tabular.TAXA)


@R.query("SELECT n_nationkey::BIGINT AS id, n_name AS value FROM nation")
def indexed_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC2."""
    return tabular.indexed_text(spark, lines(spark, table(spark, d, "nation"), F.concat_ws(" ", "n_nationkey", "n_name")))


@R.query("SELECT n_nationkey::BIGINT AS class_id, replace(n_name, '_', ' ') AS name FROM nation")
def class_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """SRC3."""
    number = F.col("n_nationkey") + 1
    return tabular.class_names(spark, lines(spark, table(spark, d, "nation"), F.concat(number.cast("string"), F.lit(" "), F.lpad(number.cast("string"), 3, "0"), F.lit("."), F.replace("n_name", F.lit(" "), F.lit("_")))))


def _species(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "taxa").withColumn("_x", F.crc32("taxon_id"))
    return t.select(
        F.col("taxon_id").alias("birdnet_id"), "scientific_name", "common_name", F.when(F.col("taxon_id").endswith("3"), "Insecta").otherwise("Aves").alias("taxon_group"),
        F.when(F.col("taxon_id").endswith("7"), "subspecies").otherwise("species").alias("record_type"), F.concat_ws("|", "common_name", F.split("scientific_name", " ")[0]).alias("aliases"),
    )


_SPECIES = "s AS (SELECT taxon_id AS birdnet_id, scientific_name, common_name, split_part(scientific_name, ' ', 1) AS genus FROM taxa WHERE NOT suffix(taxon_id, '3') AND NOT suffix(taxon_id, '7'))"


@R.query("WITH " + _SPECIES + " SELECT birdnet_id, scientific_name, common_name FROM s")
def species_csv(spark: SparkSession, d: str) -> DataFrame:
    """SRC4, FIL4, SNK3: the species of one group from a CSV; ids have to be there, once each."""
    path = folder(spark)
    sinks.write_csv(_species(spark, d), path)
    species = tabular.species_table(spark, path)
    return species.join(manifest.repeated(species, "birdnet_id"), "birdnet_id", "left_anti").select("birdnet_id", "scientific_name", "common_name")


@R.query("WITH " + _SPECIES + ", a AS (SELECT birdnet_id, common_name AS x FROM s UNION ALL SELECT birdnet_id, genus FROM s) SELECT regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS alias, list_aggregate(list_sort(list_distinct(list(birdnet_id))), 'string_agg', ',') AS ids FROM a GROUP BY 1")
def species_aliases(spark: SparkSession, d: str) -> DataFrame:
    """SRC5: aliases of a species CSV."""
    path = folder(spark)
    sinks.write_csv(_species(spark, d), path)
    return tabular.alias_ids(tabular.species_table(spark, path), "aliases", "birdnet_id").withColumn("ids", F.array_join("ids", ","))


@R.query("SELECT s_suppkey::INT AS species_id, s_name AS species, 'v' || s_nationkey AS video_name, (s_suppkey * 3)::INT AS frame, i::INT AS bird, (s_nationkey % 5)::INT AS behavior, '[' || (s_suppkey + i) || ', ' || i || ', ' || (s_suppkey + 50) || ', 40]' AS box FROM supplier, range(3) t(i) WHERE i <= s_nationkey % 3")
def frame_box_csv(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: a list of 6-tuples in the last column."""
    s = table(spark, d, "supplier")
    box = lambda i: F.concat(F.lit("("), F.concat_ws(", ", F.col("s_suppkey") + i, i, F.col("s_suppkey") + 50, F.lit(40), F.col("s_nationkey") % 5, i), F.lit(")"))
    boxes = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("s_nationkey") % 3).cast("int")), box), ", "), F.lit("]"))
    path = folder(spark)
    s.select(F.col("s_suppkey").alias("species_id"), F.col("s_name").alias("species"), F.concat(F.lit("v"), "s_nationkey").alias("video_name"), (F.col("s_suppkey") * 3).alias("frame"), boxes.alias("bounding_boxes")).write.option("header", True).option("sep", ";").csv(path)
    out = tabular.frame_boxes(spark, path)
    return out.withColumn("box", F.concat(F.lit("["), F.array_join(F.transform("box", lambda x: x.cast("int").cast("string")), ", "), F.lit("]")))


@R.query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def id_names_csv(spark: SparkSession, d: str) -> DataFrame:
    """SRC7: exactly two columns."""
    path = folder(spark)
    table(spark, d, "region").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    return tabular.csv_table(spark, path, ("r_regionkey", "r_name"), exact=True)


@R.query(
    """WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS clip, 'p' || (l_partkey % 40) AS species, l_linenumber AS behavior, l_suppkey % 20 AS first_frame, l_suppkey % 20 + l_quantity::INT - 10 AS last_frame FROM lineitem)
SELECT clip, 'unknown species' AS problem FROM c WHERE substr(species, 2)::INT >= 35 UNION ALL SELECT clip, 'unknown behavior' FROM c WHERE behavior > 6 UNION ALL SELECT clip, 'empty' FROM c WHERE first_frame > last_frame"""
)
def behavior_clip_csv(spark: SparkSession, d: str) -> DataFrame:
    """SRC8: clips held against the species and behaviors they name."""
    first = F.col("l_suppkey") % 20
    path = folder(spark)
    table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("clip"), F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("species"), F.col("l_linenumber").alias("behavior"), first.alias("first_frame"), (first + F.col("l_quantity").cast("int") - 10).alias("last_frame")
    ).write.option("header", True).csv(path)
    species = spark.range(35).select(F.concat(F.lit("p"), "id").alias("species"))
    behaviors = spark.range(1, 7).select(F.col("id").cast("string").alias("behavior"))
    return tabular.clip_problems(tabular.csv_table(spark, path, ("clip", "species", "behavior", "first_frame", "last_frame")), species, behaviors)


@R.query("SELECT n_name AS video_name, CASE n_regionkey WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM nation WHERE n_regionkey < 3")
def split_list_json(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: a JSON object of name lists; the nations are a list of bounded size."""
    names = {r: [n for n, k in table(spark, d, "nation").select("n_name", "n_regionkey").toLocalIterator() if k == r] for r in range(3)}
    doc = json.dumps({"train_set": names[0], "val_set": names[1], "test_set": names[2]}).encode()
    return tabular.split_lists(spark, put(spark, f"{folder(spark)}/splits.json", doc))


def document(spark: SparkSession, arrays: dict[str, DataFrame]) -> str:
    """One JSON object with an array of each table's rows. The rows are written in parallel, as gzip members, which are
    strung together as streams into one file."""
    jvm, folder_ = spark.sparkContext._jvm, folder(spark)
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder_}/{name}")
    files = path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(path("document.json.gz"), False)
    try:
        for n, (name, df) in enumerate(arrays.items()):
            stream.write(bytearray(gzip.compress((("]," if n else "{") + f"{json.dumps(name)}:[\n").encode())))
            row = F.to_json(F.struct(*df.columns))
            first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition
            df.select(F.when(first, row).otherwise(F.concat(F.lit(","), row)).alias("value")).write.option("compression", "gzip").text(f"{folder_}/{name}")
            filled = False
            for part in sorted(p for p in (f.getPath().getName() for f in files.listStatus(path(name))) if p[0] not in "_."):
                with_rows = jvm.java.util.zip.GZIPInputStream(files.open(path(f"{name}/{part}")))
                start = with_rows.read()
                with_rows.close()
                if start < 0:
                    continue
                if filled and start != ord(","):
                    stream.write(bytearray(gzip.compress(b",")))
                filled, content = True, files.open(path(f"{name}/{part}"))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(content, stream, 1 << 16, False)
                content.close()
            files.delete(path(name), True)
        stream.write(bytearray(gzip.compress(b"]}" if arrays else b"{}")))
    finally:
        stream.close()
    return f"{folder_}/document.json.gz"


def _coco(spark: SparkSession, d: str) -> str:
    """A COCO document: customers are images, orders annotations, nations categories. It is one JSON value in one file."""
    i = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("file_name"), F.lit(320).alias("width"), (F.lit(200) + F.col("c_custkey") % 40).cast("int").alias("height"))
    x, y = (F.col("o_orderkey") % 360 - 20).cast("double"), (F.col("o_orderkey") % 230 - 10).cast("double")
    a = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("image_id"), (F.col("o_orderkey") % 25).cast("int").alias("category_id"), F.array(x, y, F.lit(40.0), F.lit(25.5)).alias("bbox"))
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 3, "Bird").when(F.col("n_nationkey") == 4, "empty").otherwise(F.col("n_name")).alias("name"))
    return document(spark, {"images": i, "annotations": a, "categories": c})


_PLAN = """o AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS image, n_name AS category, (o_orderkey % 360 - 20)::DOUBLE AS x0, (o_orderkey % 230 - 10)::DOUBLE AS y0, 320::DOUBLE AS w, (200 + o_custkey % 40)::DOUBLE AS h FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 JOIN customer ON c_custkey = o_custkey WHERE n_nationkey NOT IN (3, 4)),
b AS (SELECT *, greatest(x0, 0) AS l, greatest(y0, 0) AS t, least(x0 + 40, w) AS r, least(y0 + 25.5::DOUBLE, h) AS m FROM o), p AS (SELECT *, x0 < 0 OR y0 < 0 OR x0 + 40 > w OR y0 + 25.5::DOUBLE > h AS changed FROM b WHERE l < r AND t < m)"""


@R.query("WITH " + _PLAN + " SELECT id, image::VARCHAR AS image_id, category, l AS left_, t AS top_, r AS right_, m AS bottom_, changed FROM p")
def coco_crops(spark: SparkSession, d: str) -> DataFrame:
    """SRC10, CMP1, CMP3, CMP4, FIL6: typed crops of a COCO document, coarse categories left out."""
    p = archives.coco_plan(*archives.coco(spark, _coco(spark, d)))
    at = lambda i: F.get("box", F.lit(i))
    return p.select("id", "image_id", "category", at(0).alias("left_"), at(1).alias("top_"), at(2).alias("right_"), at(3).alias("bottom_"), "changed")


@R.query("WITH " + _PLAN + ", n AS (SELECT (SELECT count(*) FROM customer) AS images, (SELECT count(*) FROM orders) AS annotations, (SELECT count(*) FROM nation) AS categories, count(*) AS crops, count(DISTINCT category) AS taxa, count(DISTINCT image) AS used_images, count(*) FILTER (changed) AS clipped FROM p) UNPIVOT n ON images, annotations, categories, crops, taxa, used_images, clipped INTO NAME item VALUE found")
def coco_counts(spark: SparkSession, d: str) -> DataFrame:
    """CMP1-CMP4: what a plan's expected counts are held against."""
    images, annotations, categories = archives.coco(spark, _coco(spark, d))
    return archives.plan_counts(images, annotations, categories, archives.coco_plan(images, annotations, categories))


@R.query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, 1 + n_nationkey % 4 AS images FROM nation WHERE n_regionkey = 1")
def tar_member_json(spark: SparkSession, d: str) -> DataFrame:
    """SRC11, FIL5, CMP5: a JSON member of a tar.gz, one supercategory and the images that it retains."""
    cats = [{"id": k, "name": n, "supercategory": "Birds" if r == 1 else "Other"} for k, n, r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()]
    path = folder(spark)
    annotations = [{"id": 10 * c["id"] + i, "image_id": 100 * c["id"] + i, "category_id": c["id"]} for c in cats for i in range(1 + c["id"] % 4)]
    doc = json.dumps({"categories": cats, "annotations": annotations}).encode()
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as t:
        info = tarfile.TarInfo("mini/train.json")
        info.size = len(doc)
        t.addfile(info, io.BytesIO(doc))
    put(spark, f"{path}/train.tar.gz", packed.getvalue())
    schema = "categories array<struct<id:bigint,name:string,supercategory:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint>>"
    member = archives.tar_json(spark, path, "train.json", schema)
    kept, retained = archives.supercategory(member.select(F.explode("categories").alias("_c")).select("_c.*"), member.select(F.explode("annotations").alias("_a")).select("_a.*"), "Birds")
    return kept.join(retained.groupBy("category_id").agg(F.count_distinct("image_id").alias("images")), F.col("id") == F.col("category_id")).select(F.col("id").cast("string").alias("id"), "name", "images")


def _zip(spark: SparkSession, d: str) -> str:
    """A ZIP with one text member a nation, of annotation lines, and one that nobody expects."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for k, n in sorted(map(tuple, table(spark, d, "nation").select("n_nationkey", "n_name").collect())):
            z.writestr(f"d/{k}.txt", "".join(f"images/train/{k}/frame_{i}_{i + 1}.png {n.replace(' ', '_')}\n" for i in range(3)))
        z.writestr("d/extra.txt", "\n")
    return put(spark, f"{folder(spark)}/a.zip", packed.getvalue())


@R.query("SELECT 'train' AS split, n_nationkey::VARCHAR AS category, 'frame_' || i AS frame, (i + 1)::INT AS object, replace(n_name, ' ', '_') AS label FROM nation, range(3) t(i)")
def zip_annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC12, SRC15, STR10."""
    return archives.annotation_lines(archives.zip_texts(spark, _zip(spark, d)))


@R.query("SELECT 'd/' || n_nationkey || '.csv' AS member, 'missing' AS problem FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'd/' || n_nationkey || '.txt', 'extra' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'd/extra.txt', 'extra'")
def zip_member_problems(spark: SparkSession, d: str) -> DataFrame:
    """SRC13, SRC14, VAL26."""
    expected = table(spark, d, "nation").select(F.concat(F.lit("d/"), "n_nationkey", F.when(F.col("n_regionkey") == 2, ".csv").otherwise(".txt")).alias("member"))
    return archives.member_problems(spark, _zip(spark, d), expected, "member")


@R.query("SELECT n_nationkey || '.img' AS name, strlen(n_name)::BIGINT AS length, sha256(n_name) AS sha256 FROM nation")
def image_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC22, HSH1, SNK6."""
    path = folder(spark)
    for k, n in table(spark, d, "nation").select("n_nationkey", "n_name").collect():
        put(spark, f"{path}/{k}.img", n.encode())
    return archives.images(spark, path).select(F.substring_index("path", "/", -1).alias("name"), "length", "sha256")


@R.query("SELECT n_nationkey || '.txt' AS name, CASE WHEN n_regionkey = 0 THEN 'missing' WHEN n_regionkey = 1 THEN 'extra' ELSE 'changed' END AS problem FROM nation WHERE n_regionkey < 3")
def checksum_audit(spark: SparkSession, d: str) -> DataFrame:
    """SNK6, VAL15, VAL19: a directory against its recorded checksums."""
    path, recorded = folder(spark), []
    for k, n, r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        import hashlib

        if r != 0:
            put(spark, f"{path}/{k}.txt", n.encode())
        if r != 1:
            recorded.append((f"{k}.txt", hashlib.sha256(n.encode() + b"!" * (r == 2)).hexdigest()))
    return sinks.checksum_problems(spark, path, spark.createDataFrame(recorded, "name string, sha256 string"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    top = F.array(*[((F.col("label") + i * (F.col("vec_id") % 3)) % 10).cast("int") for i in range(2)])
    after = F.when(F.col("vec_id") % 7 == 0, F.array(F.lit(11), F.lit(12))).otherwise(F.reverse(top))
    return e.select(
        F.col("vec_id").alias("sample_index"), F.col("vec_id").alias("image_id"), F.concat(F.lit("i/"), "vec_id").alias("relative_path"), F.col("label").cast("int").alias("target_class_id"), F.get(top, F.lit(0)).alias("baseline_top1_class_id"), top.alias("baseline_topk_class_ids"),
        F.get(after, F.lit(0)).alias("after_top1_class_id"), after.alias("after_ranked_class_ids"), F.lit(True).alias("target_in_baseline_topk"), F.lit(True).alias("baseline_top1_correct"), (F.get(after, F.lit(0)) == F.col("label")).alias("after_top1_correct"),
    )


@R.query("SELECT vec_id AS sample_index, 'candidates repeat' AS problem FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'ranking leaves the candidates' FROM embeddings WHERE vec_id % 7 = 0")
def prediction_audit(spark: SparkSession, d: str) -> DataFrame:
    """SRC27, SNK1: predictions written, read and held against themselves."""
    path = folder(spark)
    sinks.write_jsonl(_predictions(spark, d), path)
    return tabular.prediction_violations(tabular.jsonl(spark, path, tabular.PREDICTIONS))


@R.query(
    """SELECT coalesce(problem, 'right') AS problem, count(*) AS rows FROM (SELECT CASE event_id % 6 WHEN 1 THEN 'kind' WHEN 2 THEN 'keys' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'kind' WHEN 5 THEN CASE WHEN event_id % 600 = 5 THEN 'too long' END END AS problem FROM events) GROUP BY 1"""
)
def strict_lines(spark: SparkSession, d: str) -> DataFrame:
    """SRC28, JSN1, JSN2: lines with every kind of fault, none coerced."""
    i, n = F.col("event_id").cast("string"), F.col("event_id") % 6
    good = F.concat(F.lit('{"i":'), i, F.lit(',"ok":true,"t":"x"}'))
    line = (
        F.when(n == 1, F.concat(F.lit('{"i":'), i, F.lit(',"ok":1,"t":"x"}'))).when(n == 2, F.concat(F.lit('{"i":'), i, F.lit(',"ok":true,"t":"x","u":1}'))).when(n == 3, F.concat(F.lit('{"i":'), i, F.lit(',"ok":true,"t":')))
        .when(n == 4, F.concat(F.lit('{"i":"'), i, F.lit('","ok":true,"t":"x"}'))).when(F.col("event_id") % 600 == 5, F.concat(F.lit('{"i":'), i, F.lit(',"ok":true,"t":"'), F.repeat(F.lit("y"), tabular.MAX_LINE), F.lit('"}'))).otherwise(good)
    )
    read = tabular.strict_jsonl(spark, lines(spark, table(spark, d, "events"), line), "i bigint, ok boolean, t string")
    return read.groupBy(F.coalesce("_problem", F.lit("right")).alias("problem")).agg(F.count(F.lit(1)).alias("rows"))


@R.query("SELECT a.i::INT AS first_id, b.i::INT AS second_id, CASE WHEN (a.i + b.i) % 4 = 0 THEN 'missing' ELSE 'extra' END AS problem FROM range(25) a(i), range(26) b(i) WHERE a.i < b.i AND ((b.i < 25 AND (a.i + b.i) % 4 = 0) OR (b.i = 25 AND (a.i + b.i) % 4 <> 0))")
def prompt_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SRC26: pairs of the nations' ids that have no descriptions, and pairs beyond the classes."""
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("first_id"))
    pairs = ids.withColumn("second_id", F.explode(F.sequence(F.col("first_id") + 1, F.lit(25)))).where((F.col("first_id") + F.col("second_id")) % 4 != 0)
    d_ = F.array(F.struct(F.lit("size").alias("attribute"), F.lit("a").alias("first"), F.lit("b").alias("second")))
    path = lines(spark, pairs, F.to_json(F.struct("first_id", "second_id", d_.alias("descriptions"))))
    return tabular.pair_problems(tabular.pair_prompts(spark, path), 25)


@R.query("SELECT vector_id AS k, 'norm' AS problem FROM cached_features WHERE vector_id % 2 = 0 AND len(features) = 64 AND len([x FOR x IN features IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND abs(sqrt(list_dot_product(features::DOUBLE[], features::DOUBLE[])) - 1) > 1e-3 UNION ALL SELECT vector_id, 'width' FROM cached_features WHERE vector_id % 2 = 0 AND coalesce(len(features), 0) <> 64")
def cached_feature_audit(spark: SparkSession, d: str) -> DataFrame:
    """SRC24, SRC25, SNK10, VAL29: a cache filled in two runs, the second of which adds what is missing."""
    path = folder(spark)
    f = table(spark, d, "cached_features").where("vector_id % 2 = 0").select(F.col("vector_id").alias("k"), F.col("features").alias("v"), F.lit(0).alias("label"))
    features.write_missing(spark, f.where("k % 4 = 0"), path, "k")
    features.write_missing(spark, f, path, "k")
    found = features.violations(spark.read.parquet(path), "k", "v", "label", 64, 10)
    whole = spark.read.parquet(path).where("size(v) = 64 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))").select("k")
    return found.where("problem = 'width'").unionByName(found.where("problem = 'norm'").join(whole, "k", "left_semi"))


@R.query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    """SNK2: a table in key order with one content digest, whatever the order it came in."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    paths = [folder(spark), folder(spark)]
    one, two = (sinks.write_predictions(df, p, "o_orderkey") for df, p in zip((o, o.repartition(7, "o_custkey")), paths))
    if one != two:
        raise ValueError("the digest depends on the order of the rows")
    return spark.read.parquet(paths[1]).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.query("SELECT 'part-' || (c_custkey % 3) AS shard, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def resumed_ingestion(spark: SparkSession, d: str) -> DataFrame:
    """SNK10 as a stream: shards that arrive later are read once each, and a further call adds nothing."""
    source, target, check = (folder(spark) for _ in range(3))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("part-"), F.col("c_custkey") % 3).alias("shard_name"))
    for i in (0, 1, 2, 2):
        if i < 2 or not shards_done(spark, target, i):
            c.where(F.col("shard_name") == f"part-{i}").coalesce(1).write.mode("append").json(source)
        shards.ingest(spark, source, "k bigint, shard_name string", target, check)
    return spark.read.parquet(target).groupBy(F.col("shard_name").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("keys"))


def shards_done(spark: SparkSession, target: str, i: int) -> bool:
    return not spark.read.parquet(target).where(F.col("shard_name") == f"part-{i}").isEmpty()


@R.query("SELECT upper(common_name[1]) || lower(common_name[2:]) AS prompt, 8::BIGINT AS width, true AS unit FROM (SELECT DISTINCT common_name FROM taxa) WHERE common_name IS NOT NULL")
def encoded_prompts(spark: SparkSession, d: str) -> DataFrame:
    """EXT1-EXT3, SET7: every distinct prompt once through a batched encoder."""
    p = table(spark, d, "taxa").select("common_name").distinct().select(capitalized(F.col("common_name")).alias("prompt"))
    e = features.encode_texts(p.unionByName(p), "prompt", features.hashing_encoder(8))
    length = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("prompt", F.size("features").cast("bigint").alias("width"), (F.abs(length - 1) < 1e-9).alias("unit"))
