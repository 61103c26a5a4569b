"""Deeply nested payloads as flat tables: interval labels by depth-first traversal, parents by interval containment.

Every node of a payload gets its pre-order number and the highest pre-order number below it (`post`), so node p holds
node c exactly if p.pre < c.pre <= p.post. Node tables are filters of the labelled table by type, a path without its
positions. Links are found from the labels alone: within a payload, the enclosing node of level l - 1 is the last one
before c in pre-order, a window over one shuffle in which no node meets more than its payload's own nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.runtime import ship
from tarsus.sources.payloads import kind_of, read_object

LABELS = "result_id bigint, pre int, post int, level int, type string, node_path string, name string, kind string, element boolean, value string, owner int"


def label_tree(root: dict | list, wanted: str = "all") -> list[tuple]:
    """(pre, post, level, type, path, name, kind, element, value, owner) of each node in pre-order, without recursion.

    `level` counts the enclosing objects that are array elements. `owner` is the pre-order number of the nearest
    enclosing object, or of the payload where that is an array; the payload itself has none. wanted="elements" returns only those objects.
    """
    out: list[list] = []
    clock = 0
    stack: list[tuple] = [(root, "", "", "", 0, False, None)]
    closing = object()
    while stack:
        value, path, kind_path, name, level, element, owner = stack.pop()
        if value is closing:
            if path is not None:
                path[1] = clock - 1
            continue
        kind = kind_of(value) or "null"
        held = element and kind == "object"
        row = None
        if held or wanted == "all":
            leaf = None if kind in ("object", "array", "null") else value if isinstance(value, str) else json.dumps(value)
            row = [clock, clock, level, kind_path, path, name, kind, element, leaf, owner]
            out.append(row)
        below_of = clock if kind == "object" or owner is None else owner
        clock += 1
        if kind == "object" or kind == "array":
            stack.append((closing, row, None, None, 0, False, None))
            below = level + held
            if kind == "object":
                dot, kind_dot = (path + "." if path else ""), (kind_path + "." if kind_path else "")
                children = [(v, dot + k, kind_dot + k, k, below, False, below_of) for k, v in value.items()]
            else:
                children = [(v, f"{path}[{i}]", kind_path + "[]", name, below, True, below_of) for i, v in enumerate(value)]
            stack.extend(reversed(children))
    return [tuple(r) for r in out]


def label_nodes(results: DataFrame, id_col: str = "result_id", payload_col: str = "payload", wanted: str = "all") -> DataFrame:
    """The labelled nodes of every readable payload, once for each id however often it arrives.

    Unreadable, empty and null payloads and rows without an id have no nodes. Arrivals of an id carry one payload.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LABELS.split(", ")]
        for batch in batches:
            rows = []
            for rid, payload in zip(batch["_id"], batch["_payload"]):
                root = read_object(payload)
                if root is not None:
                    rows += [(rid, *r) for r in label_tree(root, wanted)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    ship(results.sparkSession)
    source = results.where(F.col(id_col).isNotNull() & F.col(payload_col).isNotNull())
    nodes = source.select(F.col(id_col).alias("_id"), F.col(payload_col).alias("_payload")).mapInPandas(run, LABELS)
    return nodes.repartition("result_id").dropDuplicates(["result_id", "pre"])


def link_elements(nodes: DataFrame) -> DataFrame:
    """(result_id, node_path, parent_path, ...) of the objects that are array elements, each with the nearest one whose
    interval contains it, or the empty string."""
    elements = nodes.where("element and kind = 'object'").select("result_id", "pre", "post", "level", "type", "node_path")
    roles = elements.withColumn("_as", F.explode(F.array(F.lit(0), F.lit(1))))  # 0: the parent of nodes a level deeper, 1: a child
    roles = roles.withColumn("_slot", F.col("level") - F.col("_as"))
    before = W.partitionBy("result_id", "_slot").orderBy("pre", "_as").rowsBetween(W.unboundedPreceding, W.currentRow)
    outer = F.last(F.when(F.col("_as") == 0, F.struct("pre", "post", "node_path")), ignorenulls=True).over(before)
    linked = roles.withColumn("_outer", outer).where("_as = 1")
    inside = (F.col("_outer.pre") < F.col("pre")) & (F.col("post") <= F.col("_outer.post"))
    return linked.select(
        "result_id", "node_path", F.when(inside, F.col("_outer.node_path")).otherwise("").alias("parent_path"), "type", "pre", "post", F.when(inside, F.col("_outer.pre")).alias("parent_pre")
    )


def scalar_table(nodes: DataFrame, prefix: str) -> DataFrame:
    """(result_id, field, kind, value, pre, post) of the nodes directly under `prefix` ("" for the payload itself)."""
    depth = prefix.count(".") + 1 if prefix else 0
    under = F.col("type").startswith(prefix + ".") if prefix else F.col("type") != ""
    direct = F.size(F.split("type", r"\.")) == depth + 1
    flat = ~F.col("type").contains("[]")
    return nodes.where(under & direct & flat).select("result_id", F.col("name").alias("field"), "kind", "value", "pre", "post")


def child_fields(nodes: DataFrame, parents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The parents' rows with the scalar fields directly below them, found by containment: a field's node lies in the
    interval of its parent, one step further down its path."""
    last = F.substring_index("node_path", ".", -1)
    up = F.expr("left(node_path, length(node_path) - length(substring_index(node_path, '.', -1)) - 1)")
    leaves = nodes.where(last.isin(*fields) & F.col("value").isNotNull()).select("result_id", up.alias("node_path"), last.alias("_f"), F.col("value").alias("_v"), F.col("pre").alias("_pre"))
    joined = parents.join(leaves, ["result_id", "node_path"], "left")
    own = (F.col("_pre") > F.col("pre")) & (F.col("_pre") <= F.col("post"))
    return joined.groupBy(*parents.columns).agg(*[F.max(F.when((F.col("_f") == f) & own, F.col("_v"))).alias(f) for f in fields])


def node_rows(nodes: DataFrame) -> DataFrame:
    """One row per payload, object and array element of any kind, linked to its owner: (result_id, node_path, type, kind,
    value, pre, post, parent_path, parent_type, parent_pre). value is that of an element that is a scalar."""
    rows = nodes.where("pre = 0 or kind = 'object' or element").select("result_id", "node_path", "type", "kind", "value", "pre", "post", F.col("owner").alias("parent_pre"))
    parents = nodes.where("pre = 0 or kind = 'object'").select("result_id", F.col("pre").alias("parent_pre"), F.col("node_path").alias("parent_path"), F.col("type").alias("parent_type"))
    return rows.join(parents, ["result_id", "parent_pre"], "left").select("result_id", "node_path", "type", "kind", "value", "pre", "post", "parent_path", "parent_type", "parent_pre")


def node_fields(nodes: DataFrame) -> DataFrame:
    """One row per scalar or null field of any object: (result_id, node_path, type, pre, field, kind, value), the first
    four those of the object."""
    owners = nodes.where("kind = 'object'").select("result_id", F.col("pre").alias("owner"), F.col("node_path").alias("_path"), F.col("type").alias("_type"))
    leaves = nodes.where("pre > 0 and not element and kind not in ('object', 'array')").select("result_id", "owner", F.col("name").alias("field"), "kind", "value")
    return owners.join(leaves, ["result_id", "owner"]).select("result_id", F.col("_path").alias("node_path"), F.col("_type").alias("type"), F.col("owner").alias("pre"), "field", "kind", "value")


def node_table(nodes: DataFrame, chosen: Column) -> DataFrame:
    """The rows of `node_rows` that are chosen, with a column for each scalar field that any of them holds.

    The fields come from the nodes. A field whose name is taken, in whatever case, gets a number behind it.
    """
    rows, fields = node_rows(nodes).where(chosen), node_fields(nodes)
    held = fields.join(rows.select("result_id", "pre"), ["result_id", "pre"], "left_semi").select("result_id", "pre", "field", "value")
    taken, columns = {c.lower() for c in rows.columns}, []
    for (field,) in held.select("field").distinct().orderBy("field").collect():  # names, not rows
        name = next(n for n in (field, *(f"{field}_{i}" for i in range(2, 10_000))) if n.lower() not in taken)
        taken.add(name.lower())
        columns.append(F.max(F.when(F.col("field") == field, F.col("value"))).alias(name))
    if not columns:
        return rows
    return rows.join(held.groupBy("result_id", "pre").agg(*columns), ["result_id", "pre"], "left")
