"""Queries of the problems that belong to the core: nested payloads (p2) and drifting schemas (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsus.operators import drift, nested
from tarsus.plans.registry import Query
from tarsus.runtime import materialize, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.label_nodes(table(spark, d, "run_results"), wanted="elements")
    return nested.link_elements(nodes).select("result_id", "node_path", "parent_path")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(nested.label_nodes(table(spark, d, "run_results")))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every payload, object and array element, of whatever type, with its parent."""
    return nested.node_rows(_nodes(spark, d))


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every scalar field of every object, of whatever type."""
    return nested.node_fields(_nodes(spark, d))


def _typed(kind_path: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.node_table(_nodes(spark, d), F.col("type") == kind_path)

    return query


#: One table a type of node; types that are not named here are in p2_nodes and p2_fields as well.
TYPES = {
    "p2_baselines": "evaluation.baseline",
    "p2_sources": "evaluation.sources[]",
    "p2_tasks": "evaluation.sources[].tasks[]",
    "p2_seeds": "evaluation.sources[].tasks[].seeds[]",
    "p2_protocols": "protocol",
    "p2_alpha_grids": "protocol.search_config.alpha_grid[]",
    "p2_trials": "protocol.search_config.trials[]",
    "p2_history": "protocol.search_config.trials[].history[]",
    "p2_hardware": "hardware",
    "p2_devices": "hardware.devices[]",
    "p2_jobs": "hardware.devices[].jobs[]",
}


def p2_results(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_table(_nodes(spark, d), F.col("type") == "").drop("type", "kind", "value", "parent_path", "parent_type", "parent_pre")


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    nodes = materialize(nested.label_nodes(table(spark, d, "run_results")).where(F.col("type").startswith("checks")))
    checks = nested.scalar_table(nodes, "checks")
    inner = nested.node_table(nodes, (F.col("parent_type") == "checks") & (F.col("kind") == "object")).drop("type", "kind", "value", "post", "parent_path", "parent_type", "parent_pre")
    return checks.join(inner, ["result_id", "pre"], "left").withColumn("node_path", F.concat(F.lit("checks."), "field"))


def p2_environments(spark: SparkSession, d: str) -> DataFrame:
    return nested.scalar_table(nested.label_nodes(table(spark, d, "run_results")), "environment")


def p2_environment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fields and text fields of every result's environment."""
    return p2_environments(spark, d).groupBy("result_id").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("kind") == "text").alias("texts"))


def p2_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Predictions (one object or several), their shards and all other artifacts, each with its fields."""
    nodes = materialize(nested.label_nodes(table(spark, d, "run_results")).where(F.col("type").startswith("artifacts")))
    objects = nested.node_table(nodes, F.col("type").startswith("artifacts.") & (F.col("kind") == "object")).drop("kind", "value", "parent_path", "parent_type", "parent_pre")
    parents = nested.link_elements(nodes).select("result_id", "node_path", "parent_path", "parent_pre")
    return objects.join(parents, ["result_id", "node_path"], "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "run_results"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "run_results"))


def p4_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Values that the table leaves out, as a result holds a field under several names."""
    c = drift.collisions(table(spark, d, "run_results"))
    return c.withColumn("left_out", F.array_join("left_out", ", "))


QUERIES = {f.__name__: f for f in (p2_found, p2_results, p2_checks, p2_environments, p2_environment_counts, p2_artifacts, p2_nodes, p2_fields, p4_found, p4_table, p4_collisions)}
QUERIES |= {name: _typed(kind_path) for name, kind_path in TYPES.items()}

READ = """
raw AS (SELECT DISTINCT result_id, stream_id, file_no::BIGINT AS file_no, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS p FROM run_results),
once AS (SELECT * EXCLUDE (p), CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN trim(p::JSON->>'$', chr(65279) || ' ') ELSE p END AS p FROM raw),
twice AS (SELECT * EXCLUDE (p), CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN trim(p::JSON->>'$', chr(65279) || ' ') ELSE p END AS p FROM once),
readable AS (SELECT result_id, stream_id, file_no, p::JSON AS j FROM twice WHERE json_valid(p) AND json_type(p) IN ('OBJECT', 'ARRAY'))
"""
ORACLE = {
    "p2_found": f"""WITH {READ}, nodes AS (SELECT r.result_id, substr(t.fullkey, CASE WHEN t.fullkey[2] = '.' THEN 3 ELSE 2 END) AS node_path FROM readable r, json_tree(r.j) t WHERE t.type = 'OBJECT' AND suffix(t.fullkey, ']')),
up AS (SELECT a.result_id, a.node_path, max_by(b.node_path, length(b.node_path)) AS parent_path FROM nodes a LEFT JOIN nodes b ON a.result_id = b.result_id AND prefix(a.node_path, b.node_path) AND a.node_path[length(b.node_path) + 1] IN ('.', '[') GROUP BY ALL)
SELECT result_id, node_path, coalesce(parent_path, '') AS parent_path FROM up""",
    "p4_found": f"""WITH {READ}, fields AS (SELECT stream_id, file_no, par, unnest(json_keys(j, '$.' || par)) AS k, j FROM readable, (VALUES ('checks'), ('environment')) v(par) WHERE json_type(j, '$.' || par) = 'OBJECT'),
kinds AS (SELECT stream_id, file_no, par, k, CASE json_type(j, '$.' || par || '."' || k || '"') WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind FROM fields),
held AS (SELECT stream_id, file_no, par, k, min(kind) AS kind FROM kinds WHERE kind IS NOT NULL GROUP BY ALL),
files AS (SELECT *, lead(file_no) OVER w AS next_no, lag(file_no) OVER w AS prev_no FROM (SELECT DISTINCT stream_id, file_no FROM raw) WINDOW w AS (PARTITION BY stream_id ORDER BY file_no)),
a AS (SELECT h.stream_id, f.next_no AS file_no, par, k, kind FROM held h JOIN files f USING (stream_id, file_no) WHERE f.next_no IS NOT NULL),
b AS (SELECT h.* FROM held h JOIN files f USING (stream_id, file_no) WHERE f.prev_no IS NOT NULL),
d AS (SELECT stream_id, file_no, par, k, a.kind AS was, b.kind AS now FROM a FULL JOIN b USING (stream_id, file_no, par, k)),
moved AS (SELECT stream_id, file_no, par, coalesce(was, now) AS kind, list(par || '.' || k ORDER BY k) FILTER (now IS NULL) AS gone, list(par || '.' || k ORDER BY k) FILTER (was IS NULL) AS come FROM d WHERE was IS NULL OR now IS NULL GROUP BY ALL)
SELECT stream_id, file_no, 'renamed' AS change_kind, gone[1] AS field_path, come[1] AS new_path FROM moved WHERE len(gone) = 1 AND len(come) = 1
UNION ALL SELECT stream_id, file_no, 'removed', unnest(gone), '' FROM moved WHERE NOT coalesce(len(gone) = 1 AND len(come) = 1, false)
UNION ALL SELECT stream_id, file_no, 'added', unnest(come), '' FROM moved WHERE NOT coalesce(len(gone) = 1 AND len(come) = 1, false)
UNION ALL SELECT stream_id, file_no, 'retyped', par || '.' || k, '' FROM d WHERE was <> now""",
    "p2_environment_counts": f"""WITH {READ}, k AS (SELECT result_id, unnest(json_keys(j, '$.environment')) AS field, j FROM readable WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.environment') = 'OBJECT')
SELECT result_id, count(*) AS fields, count(*) FILTER (json_type(j, '$.environment."' || field || '"') = 'VARCHAR') AS texts FROM k GROUP BY result_id""",
}
