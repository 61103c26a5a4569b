import json

from pyspark.sql import functions as F

from tarsus.operators import drift, nested
from tarsus.sources.payloads import read_object

RESULTS = "result_id bigint, stream_id bigint, file_no int, payload string"


def test_read_object():
    assert read_object('﻿ {"a":1}') == {"a": 1}
    assert read_object(json.dumps(json.dumps({"a": [1]}))) == {"a": [1]}
    for bad in (None, "", " ", "null", "3", '"x"', '{"a":', "[1", "[" * 100_000):
        assert read_object(bad) is None
    assert read_object("[{}]") == [{}]


def brute(value, path="", parent=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}" if path else k, parent)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            p = f"{path}[{i}]"
            if isinstance(v, dict):
                yield p, parent
                yield from brute(v, p, p)
            else:
                yield from brute(v, p, parent)


def test_elements_link_to_the_nearest_enclosing_element(spark, rows):
    deep = {"a": {"b": [1, {"c": [{"d": {"e": [{}, [{"f": [{}]}]]}}, None]}]}, "g": [], "h": [[{"i": 1}]]}
    many = {"x": [{"y": [{"z": [{}] * 3}] * 4}] * 5}
    payloads = [json.dumps(deep), json.dumps(json.dumps(many)), "﻿" + json.dumps([{"top": [{}]}]), None, "", "{", "null"]
    data = [(i, 1, 1, p) for i, p in enumerate(payloads)] + [(0, 1, 1, payloads[0]), (None, 1, 1, payloads[0])]
    df = spark.createDataFrame(data, RESULTS).withColumn("pre", F.lit("clash")).withColumn("node_path", F.lit(1))
    got = rows(nested.link_elements(nested.label_nodes(df, wanted="elements")).select("result_id", "node_path", "parent_path"))
    want = sorted((i, *x) for i, p in enumerate(payloads) if (o := read_object(p)) is not None for x in brute(o))
    assert got == want
    assert rows(nested.link_elements(nested.label_nodes(df)).select("result_id", "node_path", "parent_path")) == want


def test_intervals_contain_exactly_the_descendants():
    nodes = nested.label_tree({"a": [{"b": 1}, {"c": {"d": [2, 3]}}], "e": None})
    for p in nodes:
        inside = {n[4] for n in nodes if p[0] < n[0] <= p[1]}
        assert inside == {n[4] for n in nodes if n[4] != p[4] and (p[4] == "" or n[4].startswith((p[4] + ".", p[4] + "[")))}


def test_flat_tables(spark):
    p = json.dumps({"run_id": "r", "checks": {"a": True, "b": {"passed": False, "expected": 3}}, "environment": {"x": None, "y": 1.5}})
    nodes = nested.label_nodes(spark.createDataFrame([(1, 1, 1, p)], RESULTS))
    checks = nested.scalar_table(nodes, "checks").withColumn("node_path", F.concat(F.lit("checks."), "field"))
    got = {r.field: (r.kind, r.passed, r.expected) for r in nested.child_fields(nodes, checks, ("passed", "expected")).collect()}
    assert got == {"a": ("boolean", None, None), "b": ("object", "false", "3")}
    assert {r.field: r.value for r in nested.scalar_table(nodes, "environment").collect()} == {"x": None, "y": "1.5"}


def test_node_tables_hold_every_field(spark, rows):
    p = {"e": {"base": {"top1": 0.5}, "s": [{"id": "a", "t": [{"role": "x", "pre": 7, "new.est": None, "Role": 2}]}, {"id": "b", "t": []}, 4]}, "run": "r"}
    nodes = nested.label_nodes(spark.createDataFrame([(1, 1, 1, json.dumps(p)), (2, 1, 1, json.dumps([{"k": True}]))], RESULTS))
    got = rows(nested.node_rows(nodes).select("result_id", "node_path", "parent_path", "value").fillna("-"))
    assert got == sorted([(1, "", "-", "-"), (1, "e", "", "-"), (1, "e.base", "e", "-"), (1, "e.s[0]", "e", "-"), (1, "e.s[0].t[0]", "e.s[0]", "-"), (1, "e.s[1]", "e", "-"), (1, "e.s[2]", "e", "4"), (2, "", "-", "-"), (2, "[0]", "", "-")])
    fields = rows(nested.node_fields(nodes).select("result_id", "node_path", "field", F.coalesce("value", F.lit("-"))))
    t = "e.s[0].t[0]"
    assert fields == sorted([(1, "", "run", "r"), (1, "e.base", "top1", "0.5"), (1, "e.s[0]", "id", "a"), (1, "e.s[1]", "id", "b"), (1, t, "role", "x"), (1, t, "pre", "7"), (1, t, "new.est", "-"), (1, t, "Role", "2"), (2, "[0]", "k", "true")])
    task = nested.node_table(nodes, F.col("type") == "e.s[].t[]").first().asDict()
    assert (task["parent_path"], task["Role"], task["role_2"], task["pre_2"], task["new.est"]) == ("e.s[0]", "2", "x", "7", None)
    assert nested.node_table(nodes, F.col("type") == "none").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], RESULTS)
    assert nested.link_elements(nested.label_nodes(none)).count() == 0
    assert drift.changes(none).count() == 0
    assert drift.consistent_table(none).count() == 0


def files(*contents):
    return [(100 * n + i, 7, n, p if isinstance(p, (str, type(None))) else json.dumps(p)) for n, f in enumerate(contents, 1) for i, p in enumerate(f)]


def test_changes(spark, rows):
    data = files(
        [{"checks": {"a": True, "b": 1}, "environment": {"e": "x"}}, "broken"],
        [{"checks": {"a": 1, "b": None}, "environment": {"f": "x"}}, {"checks": {"c": 2.5}}],  # a retyped, b -> c, e -> f
        [{"checks": {"c": 2, "d": True, "g": False}, "environment": {"f": "y"}}],  # a removed; two booleans added
        [None, "null"],  # nothing readable
        [{"checks": [1], "environment": {"f": {"z": 1}}}],
    )
    data += data[:2]  # arrivals
    got = rows(drift.changes(spark.createDataFrame(data, RESULTS).withColumn("kind", F.lit("clash"))))
    want = [
        (7, 2, "renamed", "checks.b", "checks.c"), (7, 2, "renamed", "environment.e", "environment.f"), (7, 2, "retyped", "checks.a", ""),
        (7, 3, "added", "checks.d", ""), (7, 3, "added", "checks.g", ""), (7, 3, "removed", "checks.a", ""),
        (7, 4, "removed", "checks.c", ""), (7, 4, "removed", "checks.d", ""), (7, 4, "removed", "checks.g", ""), (7, 4, "removed", "environment.f", ""),
        (7, 5, "added", "environment.f", ""),
    ]
    assert got == sorted(want)


def test_one_table_with_one_type_a_field(spark):
    data = files([{"checks": {"a": True, "b": 1}}], [{"checks": {"a": 1, "c": 2.5}}], ["{"])
    got = drift.consistent_table(spark.createDataFrame(data + data[:1], RESULTS))
    assert dict(got.dtypes)["checks__a"] == "string" and dict(got.dtypes)["checks__b"] == "double" and "checks__c" not in got.columns
    assert [(r.file_no, r.checks__a, r.checks__b) for r in got.orderBy("file_no").collect()] == [(1, "true", 1.0), (2, "1", 2.5), (3, None, None)]


def test_a_result_that_holds_two_names_of_a_field_loses_nothing_in_silence(spark):
    renamed = files([{"checks": {"a": 1}}], [{"checks": {"b": 2}}])
    both = [(900, 8, 1, '{"checks": {"a": 5, "b": 9}}'), (901, 8, 1, '{"checks": {"a": 4, "b": 4}}')]
    names = [c.split()[0] for c in RESULTS.split(", ")]
    rest = [tuple({"result_id": i, "stream_id": s, "file_no": f, "payload": p}.get(n) for n in names) for i, s, f, p in both]
    data = spark.createDataFrame(renamed + rest, RESULTS)
    got = {r.result_id: r.checks__a for r in drift.consistent_table(data).collect()}
    assert got[900] == 5.0 and got[901] == 4.0 and "checks__b" not in drift.consistent_table(data).columns
    assert [tuple(r) for r in drift.collisions(data).collect()] == [(900, 8, 1, "checks.a", "checks.a=5", ["checks.b=9"])]
