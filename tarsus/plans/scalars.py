"""Scalar functions, geometry, strict JSON, training: one query each over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.functions import geometry, text
from tarsus.functions.vectors import cosine, l2_normalize, norm, stable_share
from tarsus.operators import nested, partitions, training
from tarsus.plans import audit, problems
from tarsus.plans.registry import Registry
from tarsus.runtime import table

R = Registry()


@R.query(
    """SELECT s_suppkey, regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]', '', 'g') AS alnum, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS ascii, lower(regexp_replace(trim(s_name), '\\s+', ' ', 'g')) AS spaced,
regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, upper(s_name[1]) || lower(s_name[2:]) AS capitalized, regexp_extract(s_name, '([0-9]+)$', 1) AS digits, 's-' || lpad(s_suppkey::VARCHAR, 6, '0') AS numbered FROM supplier"""
)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """STR1, STR3, STR4, STR6, STR9, STR10, STR12, PRJ3, PRJ6."""
    n = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", text.alnum_key(n).alias("alnum"), text.ascii_key(n).alias("ascii"), text.spaced_key(n).alias("spaced"), text.slug(n).alias("slug"), text.capitalized(n).alias("capitalized"),
        F.regexp_extract(n, "([0-9]+)$", 1).alias("digits"), text.numbered_name("s-", F.col("s_suppkey")).alias("numbered"),
    )


@R.query()
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    """STR2: needs Unicode decomposition, which neither engine's SQL has."""
    return table(spark, d, "taxon_overrides").select("override_id", text.folded_key(F.col("source_scientific_name")).alias("folded"))


@R.query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:-[A-Za-z]+)*')) AS english_words FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """STR11, VAL16."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.english_words(F.col("text")).cast("bigint").alias("english_words"))


@R.query("SELECT relative_path, length(relative_path) > 0 AND NOT contains(relative_path, chr(92)) AND NOT regexp_matches(relative_path, '^([A-Za-z]:|/)') AND NOT list_contains(string_split(relative_path, '/'), '') AND NOT list_contains(string_split(relative_path, '/'), '.') AND NOT list_contains(string_split(relative_path, '/'), '..') AS safe FROM (SELECT DISTINCT relative_path FROM samples WHERE relative_path IS NOT NULL)")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """STR7, STR8."""
    return table(spark, d, "samples").where("relative_path is not null").select("relative_path").distinct().select("relative_path", text.safe_relative_path(F.col("relative_path")).alias("safe"))


@R.query("SELECT p_partkey, list_aggregate(list_filter([trim(x) FOR x IN string_split(replace(p_type, ' ', '|'), '|')], lambda x: x <> ''), 'string_agg', ',') AS aliases FROM part")
def alias_lists(spark: SparkSession, d: str) -> DataFrame:
    """STR5, SRC5."""
    return table(spark, d, "part").select("p_partkey", F.array_join(text.aliases(F.replace("p_type", F.lit(" "), F.lit("|"))), ",").alias("aliases"))


@R.query("SELECT x AS alias, list_aggregate(list_sort(list_distinct(list(p_brand))), 'string_agg', ',') AS brands FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS x FROM part) GROUP BY x")
def alias_index(spark: SparkSession, d: str) -> DataFrame:
    """SRC5: alias -> the sorted set of what it names."""
    a = table(spark, d, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("alias"))
    return a.groupBy("alias").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@R.query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, to_base64(unhex(md5(text))) AS md5_base64 FROM documents WHERE text IS NOT NULL")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """HSH1, HSH6, SNK6."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"), F.base64(F.unhex(F.md5(t))).alias("md5_base64"))


@R.query()
def text_checksums(spark: SparkSession, d: str) -> DataFrame:
    """HSH5: CRC-32, which DuckDB lacks."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc32"))


@R.query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0::DOUBLE AS self_cosine FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """MTH1, MTH2."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(e), 6).alias("norm"), F.round(F.get(l2_normalize(e), F.lit(0)), 6).alias("first"), F.round(cosine(e, e), 6).alias("self_cosine"))


@R.query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS middle, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY l_returnflag")
def interpolated_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """MTH6."""
    q = lambda p: F.round(F.percentile("l_extendedprice", F.lit(p)), 6)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(q(0.025).alias("low"), q(0.5).alias("middle"), q(0.975).alias("high"))


_BOX = """b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 400 - 20)::DOUBLE AS x0, (l_suppkey % 300 - 10)::DOUBLE AS y0, (l_partkey % 400 - 20 + l_quantity)::DOUBLE AS x1, (l_suppkey % 300 - 10 + l_quantity / 2)::DOUBLE AS y1 FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, greatest(x0, 0) AS a, greatest(y0, 0) AS b, least(x1, 320) AS c, least(y1, 240) AS d, x0 < 0 OR y0 < 0 OR x1 > 320 OR y1 > 240 AS changed FROM b)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes [x, y, width, height] from the lines' numbers, in images of 320 x 240."""
    x, y, q = (F.col("l_partkey") % 400 - 20).cast("double"), (F.col("l_suppkey") % 300 - 10).cast("double"), F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.to_corners(F.array(x, y, q, q / 2)).alias("box"))


@R.query("WITH " + _BOX + " SELECT l_orderkey, l_linenumber, a AS left_, b AS top_, c AS right_, d AS bottom_, changed FROM c WHERE a < c AND b < d")
def clipped_boxes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ4, VAL30, JN2."""
    b = _boxes(spark, d).where(geometry.valid_box(F.col("box"))).withColumn("cut", geometry.clip(F.col("box"), F.lit(320), F.lit(240))).where("cut is not null")
    at = lambda i: F.get("cut", F.lit(i))
    return b.select("l_orderkey", "l_linenumber", at(0).alias("left_"), at(1).alias("top_"), at(2).alias("right_"), at(3).alias("bottom_"), (F.col("cut") != F.col("box")).alias("changed"))


@R.query(
    "WITH "
    + _BOX
    + """, s AS (SELECT *, greatest(1, ceil(greatest(c - a, d - b) * 1.1::DOUBLE), ceil(c) - floor(a), ceil(d) - floor(b))::INT AS side FROM c WHERE a < c AND b < d),
o AS (SELECT *, least(floor(a), greatest(ceil(c) - side, floor((a + c) / 2 - side / 2)))::INT AS l, least(floor(b), greatest(ceil(d) - side, floor((b + d) / 2 - side / 2)))::INT AS t FROM s)
SELECT l_orderkey, l_linenumber, side, l AS left_, t AS top_, l + side AS right_, t + side AS bottom_, greatest(-l, 0) AS pad_left, greatest(-t, 0) AS pad_top, greatest(l + side - 320, 0) AS pad_right, greatest(t + side - 240, 0) AS pad_bottom FROM o"""
)
def square_crops(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5."""
    b = _boxes(spark, d).withColumn("cut", geometry.clip(F.col("box"), F.lit(320), F.lit(240))).where("cut is not null")
    c = b.select("l_orderkey", "l_linenumber", geometry.square_crop(F.col("cut"), F.lit(320), F.lit(240)).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    for name in ("left", "top", "right", "bottom"):
        c = c.withColumnRenamed(name, f"{name}_")
    return c


@R.query("SELECT event_id, TRY_CAST(props->>'k' AS BIGINT) AS k, json_type(props, '$.k') IS NULL OR json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') AS rejected FROM events")
def strict_json(spark: SparkSession, d: str) -> DataFrame:
    """JSN1, JSN2, SRC28: typed extraction without coercion; whatever isn't a whole number is null and rejected."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), k.isNull().alias("rejected"))


@R.query("SELECT c_custkey, c_acctbal = floor(c_acctbal) AS integral, regexp_full_match(c_name, '[A-Za-z0-9][A-Za-z0-9._#-]*') AS named FROM customer")
def integral_numbers(spark: SparkSession, d: str) -> DataFrame:
    """CND1, STR8."""
    v = F.col("c_acctbal").cast("string").try_cast("double")
    return table(spark, d, "customer").select("c_custkey", (F.floor(v) == v).alias("integral"), F.col("c_name").rlike("^[A-Za-z0-9][A-Za-z0-9._#-]*$").alias("named"))


@R.query(
    "WITH "
    + problems.READ
    + " SELECT result_id, regexp_full_match(json_extract_string(j, '$.created_at_utc'), '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[+]00:00') AS valid FROM (SELECT DISTINCT result_id, j::VARCHAR AS j FROM readable WHERE json_type(j) = 'OBJECT')"
)
def timestamp_strings(spark: SparkSession, d: str) -> DataFrame:
    """DAT1: timestamps are validated as text, as nothing computes with them; padded, marked and wrapped payloads too."""
    stamps = nested.label_nodes(table(spark, d, "run_results")).where("node_path in ('', 'created_at_utc')")
    root, stamp = F.max(F.when(F.col("node_path") == "", F.col("kind"))), F.max(F.when(F.col("node_path") == "created_at_utc", F.col("value")))
    each = stamps.groupBy("result_id").agg(root.alias("_k"), stamp.alias("_v")).where("_k = 'object'")
    return each.select("result_id", F.col("_v").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$").alias("valid"))


@R.query("SELECT taxon_id, t AS template, CASE t WHEN 0 THEN 'A photo of a ' || upper(common_name[1]) || lower(common_name[2:]) || '.' ELSE upper(scientific_name[1]) || lower(scientific_name[2:]) || ', a bird.' END AS prompt FROM taxa, range(2) r(t)")
def prototype_prompts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ3, PRJ7: two prompts a taxon."""
    t = table(spark, d, "taxa")
    a = F.concat(F.lit("A photo of a "), text.capitalized(F.col("common_name")), F.lit("."))
    b = F.concat(text.capitalized(F.col("scientific_name")), F.lit(", a bird."))
    return t.select("taxon_id", F.posexplode(F.array(a, b)).alias("template", "prompt")).withColumn("template", F.col("template").cast("bigint"))


@R.query("SELECT doc_id, len(string_split(text, ' ')) AS words, string_split(text, ' ')[1] AS first_word, list_contains(string_split(text, ' '), 'the') AS has_the FROM documents WHERE text IS NOT NULL AND text <> ''")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """ARR1: sizes, slices, membership."""
    w = F.split("text", " ")
    x = table(spark, d, "documents").where("text is not null and text <> ''")
    return x.select("doc_id", F.size(w).cast("bigint").alias("words"), F.get(w, F.lit(0)).alias("first_word"), F.array_contains(w, "the").alias("has_the"))


@R.query("SELECT n_nationkey, [r.r_name FOR x IN [1]][1] AS region FROM nation JOIN region r ON r.r_regionkey = n_regionkey")
def array_names(spark: SparkSession, d: str) -> DataFrame:
    """ARR3, MAP1: ids to names by a map of a small dimension."""
    m = table(spark, d, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("m"))
    n = table(spark, d, "nation").crossJoin(F.broadcast(m))
    return n.select("n_nationkey", F.get(F.transform(F.array("n_regionkey"), lambda i: F.element_at("m", i)), F.lit(0)).alias("region"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label is not null")
    return partitions.stratified_split(e, "label", "vec_id", 10, "2026")


@R.query()
def head_grid_search(spark: SparkSession, d: str) -> DataFrame:
    """TRN1: iterative training, held to its held-out accuracy in the tests: all rates, decays and residual weights."""
    return training.grid_search(_parts(spark, d), training.trial_table(spark), alphas=training.ALPHAS).withColumn("loss", F.round("loss", 6))


@R.query()
def head_logits(spark: SparkSession, d: str) -> DataFrame:
    """TRN2, TRN3, TRN4."""
    head = training.refit(_parts(spark, d), 0.1, 0.0)
    return training.apply_head(table(spark, d, "embeddings"), head, "vec_id").withColumn("logit", F.round("logit", 6))


@R.query()
def adapted_features(spark: SparkSession, d: str) -> DataFrame:
    """MTH8, TRN6: the adapter's forward pass under fixed weights."""
    rng = np.random.default_rng(2026)
    down, up = rng.normal(0, 0.1, (8, 64)), rng.normal(0, 0.1, (64, 8))
    return training.adapt(table(spark, d, "embeddings"), down, up, 0.1, "vec_id")


@R.query(
    "WITH "
    + audit.CLEAN
    + ", "
    + audit.EXCLUDED
    + """, held AS (SELECT taxon_id FROM taxa WHERE ('0x' || substr(sha256('held|' || taxon_id), 1, 8))::BIGINT % 4 = 0),
k AS (SELECT c.*, c.taxon_id IN (SELECT taxon_id FROM held) AS h FROM clean c WHERE taxon_id IS NOT NULL AND taxon_id NOT IN (SELECT taxon_id FROM ex)),
r AS (SELECT *, 'fit' AS role FROM k WHERE split = 'train' AND NOT h UNION ALL SELECT *, 'validation' FROM k WHERE split = 'validation' AND h UNION ALL SELECT *, 'refit' FROM k WHERE split IN ('train', 'validation'))
SELECT dataset_id, role, count(*) AS rows, count(DISTINCT taxon_id) AS taxa FROM r GROUP BY ALL HAVING count(DISTINCT taxon_id) >= 2"""
)
def source_tasks(spark: SparkSession, d: str) -> DataFrame:
    """TRN7, AG24: roles of every dataset's rows."""
    held = table(spark, d, "taxa").where(stable_share(F.col("taxon_id"), "held") % 4 == 0)
    t = training.prepared_tasks(audit.samples(spark, d, "dataset_id", "split", "taxon_id"), "dataset_id", "split", "taxon_id", held, audit._excluded(spark, d))
    return t.groupBy("dataset_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("taxon_id").alias("taxa"))


@R.query("WITH b AS (SELECT label AS task, substr(sha256(vec_id::VARCHAR), 1, 3) AS bucket, sha256(string_agg(sha256(vec_id::VARCHAR), chr(10) ORDER BY vec_id)) AS h, count(*) AS n FROM embeddings GROUP BY ALL) SELECT task, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest, sum(n)::BIGINT AS rows FROM b GROUP BY task")
def task_membership(spark: SparkSession, d: str) -> DataFrame:
    """TRN8, AG26."""
    return training.membership(table(spark, d, "embeddings").withColumnRenamed("label", "task"), "task", "vec_id")
