"""Manifest ETL and audits: filters, joins, name resolution, splits, duplicates, digests, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.functions import fields, text
from tarsus.functions.vectors import stable_share
from tarsus.operators import manifest, nested, partitions, resolve, study
from tarsus.plans import problems
from tarsus.plans.registry import Registry
from tarsus.runtime import materialize, table

R = Registry()

SQUEEZE = lambda c: f"lower(regexp_replace({c}, '^[\\s ﻿]+|[\\s ﻿]+$', '', 'g'))"
SPLIT = (
    "CASE WHEN sp IN ('train', 'training', 'trn', 'tr') THEN 'train' WHEN sp IN ('validation', 'validate', 'valid', 'val', 'vld', 'dev') THEN 'validation' WHEN sp IN ('test', 'testing', 'tst', 'te') THEN 'test' END"
)
#: The samples once each, with canonical fields: what fields.* computes, in SQL.
CLEAN = f"""
once AS (SELECT *, regexp_replace({SQUEEZE('source_split')}, '[\\s_.-]*(set|split|data)?$', '') AS sp,
  regexp_replace({SQUEEZE('sha256')}, '^sha-?256[:=\\s]*|^0x', '') AS sh,
  regexp_replace(regexp_replace({SQUEEZE('phash')}, '^0x', ''), '[:\\s-]', '', 'g') AS ph,
  regexp_replace(replace({SQUEEZE('group_id')}, '%3a', ':'), '[\\s_-]+', '-', 'g') AS gr
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at) AS arrival FROM samples) WHERE arrival = 1),
clean AS (SELECT record_id, dataset_id, source_sample_id, taxon_id, raw_label, license, author, {SPLIT} AS split,
  CASE WHEN regexp_full_match(sh, '[0-9a-f]{{64}}') AND sh <> repeat(sh[1], 64) AND sh <> '{fields.EMPTY_SHA256}' THEN sh END AS digest,
  CASE WHEN regexp_full_match(ph, '[0-9a-f]{{1,16}}') AND lpad(ph, 16, '0') NOT IN ('0000000000000000', 'ffffffffffffffff') THEN lpad(ph, 16, '0') END AS hash_hex,
  CASE WHEN regexp_full_match(gr, '[a-z][a-z0-9-]*?-?:-?[0-9]+') THEN regexp_extract(gr, '^([a-z][a-z0-9-]*?)-?:-?0*([0-9]+)$', 1) || ':' || regexp_extract(gr, '^([a-z][a-z0-9-]*?)-?:-?0*([0-9]+)$', 2) END AS grp FROM once)
"""


_FIELDS = {
    "split": ("source_split", fields.split_name), "digest": ("sha256", fields.digest256), "hash": ("phash", fields.hash64), "grp": ("group_id", fields.group_key),
}


def samples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The samples once each, the first arrival, with these columns of it: split, digest, hash and grp in canonical form,
    any other as it came. Only what is asked for is read and shuffled; arrivals fold before the shuffle."""
    s = table(spark, d, "samples")
    held = [(_FIELDS[c][1](F.col(_FIELDS[c][0])) if c in _FIELDS else F.col(c)).alias(c) for c in columns]
    return s.groupBy("record_id").agg(F.min_by(F.struct(*held), "ingested_at").alias("_r")).select("record_id", "_r.*")


@R.query("WITH " + CLEAN + "SELECT record_id, split, digest, hash_hex, grp FROM clean")
def canonical_fields(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, VAL1: canonical manifest fields of every record, once."""
    return samples(spark, d, "split", "digest", "hash", "grp").select("record_id", "split", "digest", F.lpad(F.lower(F.hex("hash")), 16, "0").alias("hash_hex"), "grp")


@R.query("WITH " + CLEAN + ", ex AS (SELECT taxon_id FROM taxa WHERE ('0x' || substr(sha256('exclude|' || taxon_id), 1, 8))::BIGINT % 5 = 0) SELECT record_id, taxon_id FROM clean WHERE split = 'train' AND taxon_id IN (SELECT taxon_id FROM taxa) AND taxon_id NOT IN (SELECT taxon_id FROM ex)")
def split_view(spark: SparkSession, d: str) -> DataFrame:
    """FIL1, JN15."""
    return manifest.split_view(samples(spark, d, "split", "taxon_id"), "train", table(spark, d, "taxa"), _excluded(spark, d), "split").select("record_id", "taxon_id")


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "taxa")
    return t.where(stable_share(F.col("taxon_id"), "exclude") % 5 == 0).select("taxon_id")


EXCLUDED = "ex AS (SELECT taxon_id FROM taxa WHERE ('0x' || substr(sha256('exclude|' || taxon_id), 1, 8))::BIGINT % 5 = 0)"


@R.query("WITH " + CLEAN + ", " + EXCLUDED + " SELECT record_id, dense_rank() OVER (ORDER BY taxon_id) - 1 AS task_label FROM clean WHERE taxon_id IS NOT NULL AND taxon_id NOT IN (SELECT taxon_id FROM ex)")
def compact_labels(spark: SparkSession, d: str) -> DataFrame:
    """FIL2, WN6."""
    rows = samples(spark, d, "taxon_id").where("taxon_id is not null").withColumn("source_label", F.col("taxon_id"))
    return manifest.compact_task(rows, "source_label", "taxon_id", _excluded(spark, d)).select("record_id", F.col("task_label").cast("bigint").alias("task_label"))


@R.query(
    f"""WITH l AS (SELECT license, string_split_regex(trim(regexp_replace(lower(license), '\\s+', ' ', 'g')), '[ _-]') AS w FROM (SELECT DISTINCT license FROM samples WHERE license IS NOT NULL)),
n AS (SELECT license, CASE WHEN regexp_full_match(w[-1], '[0-9]+([.][0-9]+)?') THEN w[:len(w) - 1] ELSE w END AS w FROM l)
SELECT license, coalesce(array_to_string(w, ' '), '') IN {text.OPEN_LICENCES} AS open FROM n"""
)
def open_licences(spark: SparkSession, d: str) -> DataFrame:
    """FIL3."""
    return table(spark, d, "samples").where("license is not null").select("license").distinct().select("license", text.open_licence(F.col("license")).alias("open"))


@R.query("WITH " + CLEAN + ", " + EXCLUDED + " SELECT dataset_id, split, count(*) FILTER (ex.taxon_id IS NOT NULL) AS excluded, count(*) FILTER (ex.taxon_id IS NULL) AS retained, count(DISTINCT c.taxon_id) FILTER (ex.taxon_id IS NOT NULL) AS excluded_taxa, count(DISTINCT c.taxon_id) FILTER (ex.taxon_id IS NULL) AS retained_taxa FROM clean c LEFT JOIN ex ON ex.taxon_id = c.taxon_id GROUP BY dataset_id, split")
def exclusion_audit(spark: SparkSession, d: str) -> DataFrame:
    """FIL7, AG23."""
    return manifest.exclusion_audit(samples(spark, d, "dataset_id", "split", "taxon_id"), _excluded(spark, d), "taxon_id", "dataset_id", "split")


@R.query("SELECT user_id, count(*) AS sampled FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) WHERE frame % 10 = 3 GROUP BY user_id")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """FIL8: every tenth frame of a video from an offset on, a user's events standing for frames."""
    return _frames(spark, d).where(F.col("frame") % 10 == 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("sampled"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    return table(spark, d, "events").select("user_id", "event_id", "event_type", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("frame"))


@R.query(
    """WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events), l AS (SELECT user_id, max(frame) + 1 AS length FROM f GROUP BY user_id),
a AS (SELECT user_id, count(DISTINCT frame) AS annotated, max(frame) + 1 AS horizon, count(DISTINCT frame) FILTER (frame % 10 = 0) AS sampled_annotated FROM f WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, length, coalesce(annotated, 0) AS annotated, coalesce(horizon, 0) AS horizon, length - coalesce(horizon, 0) AS trailing, ceil(length / 10)::BIGINT AS sampled, coalesce(sampled_annotated, 0) AS sampled_annotated, (ceil(length / 10) - ceil(coalesce(horizon, 0) / 10))::BIGINT AS sampled_trailing FROM l LEFT JOIN a USING (user_id)"""
)
def annotation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """AG28: how far the annotated frames of a video reach."""
    f = _frames(spark, d)
    lengths = f.groupBy("user_id").agg((F.max("frame") + 1).alias("length"))
    return manifest.coverage(f.where("event_type = 'purchase'"), "user_id", "frame", lengths, 10)


@R.query("WITH " + CLEAN + "SELECT dataset_id, split, count(*) AS rows FROM clean GROUP BY ALL")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG13, VAL2."""
    return manifest.group_counts(samples(spark, d, "dataset_id", "split"), "dataset_id", "split")


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY ALL")
def flag_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """AG14."""
    return manifest.mismatch_counts(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@R.query("WITH " + CLEAN + "SELECT dataset_id, count(*) AS records, count(DISTINCT taxon_id) AS taxa, count(DISTINCT grp) AS groups, count(DISTINCT (dataset_id, source_sample_id)) AS images FROM clean GROUP BY dataset_id")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG15."""
    return samples(spark, d, "dataset_id", "taxon_id", "grp", "source_sample_id").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("taxon_id").alias("taxa"), F.count_distinct("grp").alias("groups"), F.count_distinct("source_sample_id").alias("images"))


_DUP = """, g AS (SELECT digest, count(*) AS copies, count(DISTINCT dataset_id) AS datasets, arg_min(dataset_id, (dataset_id, record_id)) AS canonical_dataset, count(DISTINCT taxon_id) > 1 AS taxon_conflict FROM clean WHERE digest IS NOT NULL GROUP BY digest HAVING count(DISTINCT dataset_id) > 1)
"""


@R.query("WITH " + CLEAN + _DUP + "SELECT c.record_id, c.digest, copies, datasets, canonical_dataset, taxon_conflict, (c.split IS NOT DISTINCT FROM 'train') AND c.dataset_id <> canonical_dataset AS drops FROM clean c JOIN g USING (digest)")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """AG16, WN8: exact copies across datasets, the canonical one, and the active (train) rows of later ones that drop."""
    active = F.col("split").eqNullSafe("train")
    a = manifest.duplicate_audit(samples(spark, d, "digest", "dataset_id", "taxon_id", "split"), "digest", "dataset_id", ["dataset_id", "record_id"], "taxon_id", active)
    return a.select("record_id", "digest", "copies", "datasets", "canonical_dataset", "taxon_conflict", "drops")


@R.query("WITH " + CLEAN + _DUP + "SELECT c.dataset_id, count(*) AS reported, count(*) FILTER ((c.split IS NOT DISTINCT FROM 'train') AND c.dataset_id <> canonical_dataset) AS dropped FROM clean c JOIN g USING (digest) GROUP BY c.dataset_id")
def duplicate_drops(spark: SparkSession, d: str) -> DataFrame:
    """AG16, FIL11: how many rows of each dataset drop."""
    return exact_duplicates(spark, d).join(samples(spark, d, "dataset_id").select("record_id", "dataset_id"), "record_id").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("reported"), F.count_if("drops").alias("dropped"))


@R.query("WITH " + CLEAN + "SELECT hash_hex, count(*) AS copies, count(DISTINCT dataset_id) AS datasets FROM clean WHERE hash_hex IS NOT NULL GROUP BY hash_hex HAVING count(DISTINCT dataset_id) > 1")
def identical_hashes(spark: SparkSession, d: str) -> DataFrame:
    """AG17: equal perceptual hashes across datasets, reported only."""
    g = samples(spark, d, "hash", "dataset_id").where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("dataset_id").alias("datasets")).where("datasets > 1")
    return g.select(F.lpad(F.lower(F.hex("hash")), 16, "0").alias("hash_hex"), "copies", "datasets")


@R.query(
    "WITH "
    + CLEAN
    + """, v AS (SELECT hash_hex, ('0x' || hash_hex)::UBIGINT AS u, count(*) AS n, min(dataset_id) AS lo, max(dataset_id) AS hi FROM clean WHERE hash_hex IS NOT NULL GROUP BY ALL),
k AS (SELECT *, p, (u >> CASE p WHEN 0 THEN 0 WHEN 1 THEN 21 ELSE 42 END::UBIGINT) & CASE p WHEN 0 THEN 2097151 WHEN 1 THEN 2097151 ELSE 4194303 END::UBIGINT AS c FROM v, range(3) t(p))
SELECT DISTINCT least(a.hash_hex, b.hash_hex) AS hash_a, greatest(a.hash_hex, b.hash_hex) AS hash_b, bit_count(xor(a.u, b.u))::INT AS distance FROM k a JOIN k b ON a.p = b.p AND a.c = b.c AND a.u < b.u WHERE bit_count(xor(a.u, b.u)) <= 2 AND (a.lo <> b.hi OR a.hi <> b.lo)"""
)
def near_hashes(spark: SparkSession, d: str) -> DataFrame:
    """JN10, HSH4: near perceptual hashes across datasets by pigeonhole chunks, at most two differing bits."""
    p = manifest.near_pairs(samples(spark, d, "hash", "dataset_id"), "hash", "dataset_id", 2)
    x, y = (F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("value_a", "value_b"))
    return p.select(F.least(x, y).alias("hash_a"), F.greatest(x, y).alias("hash_b"), "distance")


@R.query("WITH " + CLEAN + "SELECT record_id, taxon_id FROM clean WHERE taxon_id IS NOT NULL AND (taxon_id NOT IN (SELECT taxon_id FROM taxa) OR taxon_id LIKE '%4')")
def unknown_taxa(spark: SparkSession, d: str) -> DataFrame:
    """JN3: records whose taxon the dimension doesn't have; some species are taken out of it."""
    return manifest.unknown_keys(samples(spark, d, "taxon_id"), table(spark, d, "taxa").where("taxon_id not like '%4'"), "taxon_id").select("record_id", "taxon_id")


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 7)")
def orphan_annotations(spark: SparkSession, d: str) -> DataFrame:
    """JN2: annotations (lines) whose image (order) is missing; some orders are taken out."""
    images = table(spark, d, "orders").where("o_orderkey % 50 <> 7").select(F.col("o_orderkey").alias("l_orderkey"))
    return manifest.unknown_keys(table(spark, d, "lineitem"), images, "l_orderkey").select("l_orderkey", "l_linenumber")


@R.query("SELECT o_orderkey AS k, CASE WHEN l.k IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM orders FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey WHERE l.k IS NULL OR o_orderkey IS NULL")
def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """JN1, SET2, VAL26: keys that one of two listings lacks."""
    return manifest.key_mismatches(table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")


@R.query("SELECT record_id, count(*) AS rows FROM samples GROUP BY record_id HAVING count(*) > 1")
def repeated_records(spark: SparkSession, d: str) -> DataFrame:
    """VAL1, SET9: ids that arrived several times."""
    return manifest.repeated(table(spark, d, "samples"), "record_id")


@R.query("WITH " + CLEAN + "SELECT grp, count(DISTINCT taxon_id) AS values FROM clean WHERE grp IS NOT NULL GROUP BY grp HAVING count(DISTINCT taxon_id) > 1")
def taxon_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """AG34, VAL24: groups whose records name several taxa."""
    return manifest.conflicting(samples(spark, d, "grp", "taxon_id").where("grp is not null"), "grp", "taxon_id")


@R.query("WITH " + CLEAN + """SELECT dataset_id, count(*) AS rows, count(DISTINCT taxon_id) AS taxa, (SELECT string_agg(s || '=' || n, ', ' ORDER BY s) FROM (SELECT coalesce(split, 'none') AS s, count(*) AS n FROM clean i WHERE i.dataset_id = c.dataset_id GROUP BY 1)) AS status_counts FROM clean c GROUP BY dataset_id""")
def partition_audit(spark: SparkSession, d: str) -> DataFrame:
    """AG24, MAP1."""
    p = manifest.partition_audit(samples(spark, d, "dataset_id", "split", "taxon_id").withColumn("status", F.coalesce("split", F.lit("none"))), "dataset_id", "status", "taxon_id")
    return p.withColumn("status_counts", F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", "))


@R.query("WITH " + CLEAN + ", b AS (SELECT dataset_id, substr(sha256(record_id::VARCHAR), 1, 3) AS bucket, sha256(string_agg(sha256(record_id || '|' || coalesce(taxon_id, '') || '|' || coalesce(digest, '')), chr(10) ORDER BY record_id)) AS h, count(*) AS n FROM clean GROUP BY ALL) SELECT dataset_id, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest, sum(n)::BIGINT AS rows FROM b GROUP BY dataset_id")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """AG25, VAL27: order-sensitive digests of row sets."""
    row = F.concat_ws("|", F.col("record_id").cast("string"), F.coalesce("taxon_id", F.lit("")), F.coalesce("digest", F.lit("")))
    return manifest.content_digest(samples(spark, d, "dataset_id", "taxon_id", "digest"), ["dataset_id"], "record_id", row)


@R.query("SELECT label, count(DISTINCT sha256(vec_id::VARCHAR)) AS digests, count(*) AS rows FROM embeddings GROUP BY label")
def digest_invariance(spark: SparkSession, d: str) -> DataFrame:
    """AG26, AG31: distinct row digests per group."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count_distinct(F.sha2(F.col("vec_id").cast("string"), 256)).alias("digests"), F.count(F.lit(1)).alias("rows"))


@R.query("SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256('2026' || chr(0) || vec_id), vec_id) <= 5 THEN 'validation' ELSE 'fit' END AS part FROM embeddings")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """WN2, WN3, HSH2."""
    return partitions.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, "2026")


@R.query("SELECT n_nationkey, n_name, CASE WHEN row_number() OVER (PARTITION BY n_nationkey // 2 ORDER BY sha256('salt' || chr(0) || n_nationkey || chr(0) || n_name), n_nationkey) = 1 THEN 'base' ELSE 'novel' END AS part FROM nation")
def adjacent_split(spark: SparkSession, d: str) -> DataFrame:
    """WN4."""
    return partitions.adjacent_split(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", "salt")


@R.query("SELECT taxon_id, CASE WHEN row_number() OVER (ORDER BY sha256('v1' || chr(0) || taxon_id)) <= greatest(1, least(count(*) OVER () - 1, round_even(count(*) OVER () * 0.15, 0)::BIGINT)) THEN 'validation' ELSE 'train' END AS part FROM taxa")
def taxon_partition(spark: SparkSession, d: str) -> DataFrame:
    """WN5."""
    return partitions.taxon_partition(table(spark, d, "taxa").select("taxon_id"), "taxon_id", 0.15, "v1")


@R.query(
    "WITH "
    + CLEAN
    + """, u AS (SELECT CASE split WHEN 'train' THEN 0 ELSE 1 END AS part_no, split AS part, record_id, taxon_id FROM clean WHERE split IN ('train', 'validation') AND taxon_id IS NOT NULL)
SELECT part, record_id, dense_rank() OVER (ORDER BY taxon_id) - 1 AS label, row_number() OVER (ORDER BY part_no, record_id) - 1 AS position FROM u"""
)
def refit_labels(spark: SparkSession, d: str) -> DataFrame:
    """WN7, SET5, FIL10: train and validation as one, relabelled, with running positions."""
    s = samples(spark, d, "taxon_id", "split").where("taxon_id is not null")
    r = partitions.refit_rows([(n, s.where(F.col("split") == n)) for n in ("train", "validation")], "taxon_id", "record_id")
    return r.select("part", "record_id", F.col("label").cast("bigint").alias("label"), F.col("position").cast("bigint").alias("position"))


@R.query(
    """WITH c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS c, count(*) OVER () AS k FROM embeddings GROUP BY label), r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
a AS (SELECT i AS draw, ('0x' || substr(sha256('7|class|' || i), 1, 8))::BIGINT % 10 AS c, ('0x' || substr(sha256('7|row|' || i), 1, 8))::BIGINT AS x FROM range(256) t(i))
SELECT draw, r.label, r.vec_id FROM a JOIN c USING (c) JOIN r ON r.label = c.label AND r.r = a.x % c.n"""
)
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """TRN5: class-balanced draws. The number of draws is the feature."""
    return partitions.balanced_draws(table(spark, d, "embeddings"), "label", "vec_id", 256, "7")


@R.query("SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 32")
def deterministic_prefix(spark: SparkSession, d: str) -> DataFrame:
    """FIL9: the first n by key; the limit is the feature."""
    return table(spark, d, "embeddings").select("vec_id").orderBy("vec_id").limit(32)


_NAMES = "regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


@R.query(
    f"""WITH l AS (SELECT override_id, source_scientific_name, {_NAMES.format(c='source_scientific_name')} AS k FROM taxon_overrides), i AS (SELECT {_NAMES.format(c='scientific_name')} AS k, count(DISTINCT taxon_id) AS n, min(taxon_id) AS id FROM taxa GROUP BY 1),
o AS (SELECT k, min('birdnet:' || birdnet_id) AS r FROM (SELECT *, {_NAMES.format(c='source_scientific_name')} AS k FROM taxon_overrides WHERE birdnet_id IS NOT NULL) GROUP BY k)
SELECT override_id, coalesce(o.r, CASE WHEN n = 1 THEN id END) AS resolved, CASE WHEN o.r IS NOT NULL THEN 'override' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS policy, coalesce(n, 0) AS matches FROM l LEFT JOIN i USING (k) LEFT JOIN o USING (k)"""
)
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """JN5, JN7, STR3: override, else the unique name; failures are told apart."""
    labels = table(spark, d, "taxon_overrides")
    key = text.ascii_key(F.col("source_scientific_name"))
    o = labels.where("birdnet_id is not null").groupBy(key.alias("key")).agg(F.min(F.concat(F.lit("birdnet:"), "birdnet_id")).alias("resolved"))
    r = resolve.crosswalk(labels.select("override_id", "source_scientific_name"), key, table(spark, d, "taxa"), text.ascii_key(F.col("scientific_name")), "taxon_id", o)
    return r.drop("source_scientific_name")


@R.query(
    f"""WITH w AS (SELECT source_species_id, {_NAMES.format(c='source_scientific_name')} AS s, {_NAMES.format(c='source_common_name')} AS c FROM wetland_alignments), si AS (SELECT {_NAMES.format(c='scientific_name')} AS s, min(taxon_id) AS id FROM taxa GROUP BY 1 HAVING count(DISTINCT taxon_id) = 1), ci AS (SELECT {_NAMES.format(c='common_name')} AS c, min(taxon_id) AS id FROM taxa GROUP BY 1 HAVING count(DISTINCT taxon_id) = 1)
SELECT source_species_id, coalesce(si.id, ci.id, 'wetland:' || source_species_id) AS resolved, CASE WHEN si.id IS NOT NULL THEN 'scientific' WHEN ci.id IS NOT NULL THEN 'common' ELSE 'own' END AS policy FROM w LEFT JOIN si ON si.s = w.s LEFT JOIN ci ON ci.c = w.c"""
)
def resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    """JN6."""
    w, t = table(spark, d, "wetland_alignments"), table(spark, d, "taxa")
    own = F.concat(F.lit("wetland:"), F.col("source_species_id").cast("string"))
    r = resolve.cascade(w.select("source_species_id", "source_scientific_name", "source_common_name"), text.ascii_key(F.col("source_scientific_name")), text.ascii_key(F.col("source_common_name")), own, t, text.ascii_key(F.col("scientific_name")), text.ascii_key(F.col("common_name")), "taxon_id")
    return r.select("source_species_id", "resolved", "policy")


@R.query("SELECT override_id FROM taxon_overrides o WHERE birdnet_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM taxa t WHERE t.taxon_id = 'birdnet:' || o.birdnet_id AND t.scientific_name = o.accepted_scientific_name AND t.common_name = CASE WHEN override_id % 5 = 0 THEN upper(o.accepted_common_name) ELSE o.accepted_common_name END)")
def lock_violations(spark: SparkSession, d: str) -> DataFrame:
    """JN8: locked ids that are unknown or disagree with their taxon; some names are written otherwise."""
    o = table(spark, d, "taxon_overrides").where("birdnet_id is not null")
    common = F.when(F.col("override_id") % 5 == 0, F.upper("accepted_common_name")).otherwise(F.col("accepted_common_name"))
    rows = o.select("override_id", F.concat(F.lit("birdnet:"), "birdnet_id").alias("taxon_id"), F.col("accepted_scientific_name").alias("scientific_name"), common.alias("common_name"))
    return resolve.locked(rows, table(spark, d, "taxa"), "taxon_id", "scientific_name", "common_name").select("override_id")


@R.query("WITH g AS (SELECT DISTINCT split_part(scientific_name, ' ', 1) AS genus FROM taxa) SELECT genus, count(*) AS species, string_agg(taxon_id, ',' ORDER BY taxon_id) AS members FROM g JOIN taxa t ON lower(split_part(t.scientific_name, ' ', 1)) = lower(genus) GROUP BY genus")
def genus_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """JN9, SET4: every genus with the ids of its species."""
    t = table(spark, d, "taxa")
    labels = t.select(F.split("scientific_name", " ")[0].alias("genus")).distinct()
    m = resolve.genus_members(labels, F.col("genus"), t, "scientific_name", "taxon_id")
    return m.select("genus", F.size("members").cast("bigint").alias("species"), F.array_join("members", ",").alias("members"))


@R.query("SELECT n_nationkey::BIGINT AS position, n_name AS name_a, CASE WHEN n_nationkey % 6 = 0 THEN 'X' || upper(n_name) END AS name_b FROM nation WHERE n_nationkey % 6 IN (0, 5)")
def vocabulary_alignment(spark: SparkSession, d: str) -> DataFrame:
    """VAL3, VAL4, STR1: a vocabulary against one in capitals with other separators, other names and gaps."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").cast("bigint").alias("position"), F.col("n_name").alias("name"))
    b = a.where("position % 6 <> 5").withColumn("name", F.when(F.col("position") % 6 == 0, F.concat(F.lit("X"), F.upper("name"))).otherwise(F.upper(F.translate("name", " _", "--"))))
    return resolve.misaligned(a, b, "position", "name", text.alnum_key)


@R.query("SELECT split_part(scientific_name, ' ', 1) AS genus, count(DISTINCT taxon_id) AS values FROM taxa GROUP BY 1 HAVING count(DISTINCT taxon_id) > 1")
def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    """VAL5: names that stand for several taxa, here those of the genera."""
    return manifest.conflicting(table(spark, d, "taxa").select(F.split("scientific_name", " ")[0].alias("genus"), "taxon_id"), "genus", "taxon_id")


@R.query("SELECT t.n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'override ' || n_nationkey ELSE n_name END AS n_name FROM nation t")
def pair_overrides(spark: SparkSession, d: str) -> DataFrame:
    """SET8: replaced by key, the rest kept."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = n.where("n_nationkey % 5 = 0").select("n_nationkey", F.concat(F.lit("override "), F.col("n_nationkey").cast("string")).alias("n_name"))
    return manifest.overridden(n, o, ["n_nationkey"], "n_name")


@R.query("SELECT source, min(doc_id) AS first_seen FROM documents WHERE source IS NOT NULL GROUP BY source")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """SET3, VAL18."""
    return manifest.first_occurrences(table(spark, d, "documents").where("source is not null"), "source", "doc_id")


@R.query("WITH " + CLEAN + "SELECT taxon_id FROM clean WHERE split = 'train' AND taxon_id IS NOT NULL INTERSECT SELECT taxon_id FROM clean WHERE split = 'test'")
def shared_taxa(spark: SparkSession, d: str) -> DataFrame:
    """SET1, SET6: taxa of both train and test; empty if the splits are disjoint by taxon."""
    s = samples(spark, d, "taxon_id", "split").where("taxon_id is not null")
    return s.where("split = 'train'").select("taxon_id").intersect(s.where("split = 'test'").select("taxon_id"))


@R.query(
    """WITH r AS (SELECT DISTINCT result_id, stream_id, file_no::BIGINT AS file_no FROM run_results), m AS (SELECT stream_id, max(file_no) AS last FROM r GROUP BY stream_id),
c AS (SELECT stream_id, unnest(range(1, last + 1)) AS file_no FROM m), n AS (SELECT stream_id, file_no, count(*) FILTER (result_id % 3 = 0) AS complete_runs FROM r GROUP BY ALL)
SELECT c.stream_id, c.file_no, coalesce(complete_runs, 0) AS complete_runs, CASE WHEN coalesce(complete_runs, 0) = 0 THEN 'missing' ELSE 'several' END AS problem FROM c LEFT JOIN n USING (stream_id, file_no) WHERE coalesce(complete_runs, 0) <> 1"""
)
def study_cells(spark: SparkSession, d: str) -> DataFrame:
    """JN16, VAL7, VAL22: every stream by every file number up to its last, each with exactly one complete run; a third
    of the results count as complete."""
    r = table(spark, d, "run_results").select("result_id", "stream_id", F.col("file_no").cast("bigint").alias("file_no")).distinct()
    cells = r.groupBy("stream_id").agg(F.max("file_no").alias("_last")).select("stream_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_last"))).alias("file_no"))
    return study.cell_problems(cells, r, ["stream_id", "file_no"], F.col("result_id") % 3 == 0)


_LEAVES = """first AS (SELECT min(result_id) AS f FROM readable WHERE json_type(j) = 'OBJECT'), once_ AS (SELECT DISTINCT result_id, stream_id, j::VARCHAR AS j FROM readable WHERE json_type(j) = 'OBJECT'),
leaf AS (SELECT r.result_id, r.stream_id, substr(t.fullkey, 3) AS field_path, CASE t.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'text' ELSE 'number' END AS kind, CASE WHEN t.type = 'VARCHAR' THEN t.atom->>'$' WHEN t.type = 'BOOLEAN' THEN t.atom::VARCHAR ELSE (t.atom::DOUBLE)::VARCHAR END AS v
  FROM once_ r, json_tree(r.j::JSON) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND prefix(t.fullkey, '$.protocol.') AND NOT contains(t.fullkey, '['))"""


@R.query(
    f"""WITH {problems.READ}, {_LEAVES}, want AS (SELECT r.result_id, w.field_path, w.kind, w.v FROM (SELECT DISTINCT result_id FROM leaf) r, first JOIN leaf w ON w.result_id = f)
SELECT coalesce(w.result_id, h.result_id) AS result_id, coalesce(w.field_path, h.field_path) AS field_path, CASE WHEN h.result_id IS NULL THEN 'missing' WHEN w.result_id IS NULL THEN 'unexpected' WHEN h.kind <> w.kind THEN 'kind' ELSE 'value' END AS problem
FROM want w FULL JOIN leaf h ON h.result_id = w.result_id AND h.field_path = w.field_path WHERE h.result_id IS NULL OR w.result_id IS NULL OR h.kind <> w.kind OR h.v <> w.v"""
)
def config_locks(spark: SparkSession, d: str) -> DataFrame:
    """VAL21, AG31: the protocol of every result against that of the first one of all; the seed counts here."""
    nodes = materialize(nested.label_nodes(table(spark, d, "run_results")).where("type = '' and kind = 'object' or (type like 'protocol.%' and type not like '%[]%')"))
    first = nodes.where("type = ''").agg(F.min("result_id").alias("result_id"))
    value = F.when(F.col("kind") == "number", F.col("value").cast("double").cast("string")).otherwise(F.col("value"))
    leaf = nodes.where("value is not null").select("result_id", F.lit("all").alias("study"), F.col("node_path").alias("field_path"), "kind", value.alias("value"))
    return study.config_problems(leaf, leaf.join(first, "result_id").drop("result_id"), "result_id", "study")


@R.query("SELECT p_partkey, (i - 1)::INT AS position, string_split(p_type, ' ')[i] AS left_value, CASE WHEN i <= len(string_split(p_type, ' ')) - (p_partkey % 2) THEN CASE WHEN p_partkey % 3 = 0 AND i = 1 THEN 'OTHER' ELSE string_split(p_type, ' ')[i] END END AS right_value FROM part, range(1, 10) t(i) WHERE i <= len(string_split(p_type, ' ')) AND right_value IS DISTINCT FROM left_value")
def zipped_lists(spark: SparkSession, d: str) -> DataFrame:
    """JN17: lists against copies of which some lack the last entry and some have another first one."""
    w = F.split("p_type", " ")
    short = F.slice(w, F.lit(1), F.size(w) - (F.col("p_partkey") % 2).cast("int"))
    other = F.transform(short, lambda x, i: F.when((F.col("p_partkey") % 3 == 0) & (i == 0), "OTHER").otherwise(x))
    return study.zipped_problems(table(spark, d, "part").select("p_partkey", w.alias("a"), other.alias("b")), "p_partkey", "a", "b")


@R.query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1 AS position FROM lineitem")
def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    """TK4: places in a composite order, numbers as numbers."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return partitions.numbered(rows, "l_returnflag", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "position")


@R.query("SELECT taxon_id, upper(x[1]) || x[2:] AS name FROM (SELECT taxon_id, lower(trim(scientific_name)) AS x FROM taxa)")
def binomial_names(spark: SparkSession, d: str) -> DataFrame:
    """STR9."""
    return table(spark, d, "taxa").select("taxon_id", text.binomial(F.upper("scientific_name")).alias("name"))


@R.query("SELECT item, expected, found FROM (SELECT 'n-' || r_regionkey AS item, CASE WHEN r_regionkey % 2 = 0 THEN 5 ELSE 4 END::BIGINT AS expected, count(*) AS found FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL) WHERE expected <> found UNION ALL SELECT 'n-9', 1, 0")
def unexpected_counts(spark: SparkSession, d: str) -> DataFrame:
    """VAL2: counts against the numbers that a data set has to have."""
    from tarsus.sources.archives import unexpected_counts as against

    found = table(spark, d, "nation").groupBy(F.concat(F.lit("n-"), "n_regionkey").alias("item")).agg(F.count(F.lit(1)).alias("found"))
    expected = spark.createDataFrame([(f"n-{i}", 5 if i % 2 == 0 else 4) for i in range(5)] + [("n-9", 1)], "item string, expected bigint")
    return against(found, expected).select("item", "expected", F.coalesce("found", F.lit(0)).alias("found"))


@R.query("SELECT s AS seed, t AS trial, 'run-' || s || '-' || t AS run_id FROM range(2026, 2029) a(s), (VALUES ('linear'), ('residual'), ('adapter')) b(t)")
def study_matrix(spark: SparkSession, d: str) -> DataFrame:
    """JN16: every seed with every trial, two small lists of the configuration."""
    seeds = spark.range(2026, 2029).withColumnRenamed("id", "seed")
    trials = spark.createDataFrame([("linear",), ("residual",), ("adapter",)], "trial string")
    return seeds.crossJoin(F.broadcast(trials)).select("seed", "trial", F.concat_ws("-", F.lit("run"), F.col("seed").cast("string"), "trial").alias("run_id"))


@R.query("SELECT p.p_type, count(*) AS lines, round(sum(l_extendedprice), 2) AS amount FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE p.p_size > 5 AND l.l_quantity > 0 GROUP BY p.p_type")
def annotation_plan(spark: SparkSession, d: str) -> DataFrame:
    """JN2: lines to parts and orders, counted by type; coco_crops has the plans over COCO documents."""
    part = table(spark, d, "part").where("p_size > 5").select("p_partkey", "p_type")
    lines = table(spark, d, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_partkey", "l_extendedprice")
    j = lines.join(part, lines.l_partkey == part.p_partkey).join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return j.groupBy("p_type").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@R.query("SELECT o_orderstatus AS status, o_orderpriority AS position, count(*) AS rows FROM orders GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG13: counts by two keys."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("position")).agg(F.count(F.lit(1)).alias("rows"))
