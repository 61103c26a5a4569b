"""Schemas that drift from file to file: a catalogue of field lifespans, the changes, and one table with one type a field.

The footers of all files (which fields a file holds, and of what kind) are folded to one row per stream, file and field
before any shuffle of the payloads. Lag and lead over the file's position in its stream turn these rows into islands,
the lifespans; islands that start after the first file or end before the last one are the changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.runtime import ship
from tarsus.sources.payloads import kind_of, read_object

PARENTS = ("checks", "environment")


def fields_of(results: DataFrame, keep: tuple[str, ...], values: bool = False) -> DataFrame:
    """Rows (keep..., parent, field, kind, value) for the non-null fields directly under the parents.

    Without `values`, a batch's repeated rows are folded and value is null.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in results.select(*keep).schema), "parent string", "field string", "kind string", "value string"])
    names = [*keep, "parent", "field", "kind", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for *ids, payload in batch[[*keep, "payload"]].itertuples(index=False, name=None):
                root = read_object(payload)
                for parent in PARENTS if isinstance(root, dict) else ():
                    held = root.get(parent)
                    for name, value in held.items() if isinstance(held, dict) else ():
                        if (kind := kind_of(value)) is not None:
                            text = None if not values else value if kind == "text" else json.dumps(value)
                            rows.append((*ids, parent, name, kind, text))
            if rows:
                out = pd.DataFrame(rows, columns=names)
                yield out if values else out.drop_duplicates()

    ship(results.sparkSession)
    return results.select(*keep, "payload").mapInPandas(run, schema)


def lifespans(results: DataFrame) -> DataFrame:
    """One row per stream, file and field held: kind, the file's position in its stream, and the neighbours' positions.

    If the payloads of one file disagree on a field's kind, the kind first in alphabetical order stands for the file.
    A file without any readable payload counts as a file without fields. Rows without stream or file number are left out.
    """
    rows = results.select("stream_id", F.col("file_no").cast("bigint").alias("file_no"), "payload").where("stream_id is not null and file_no is not null")
    files = rows.select("stream_id", "file_no").distinct()
    order = W.partitionBy("stream_id").orderBy("file_no")
    files = files.withColumn("_at", F.row_number().over(order)).withColumn("_next_file", F.lead("file_no").over(order))
    held = fields_of(rows, ("stream_id", "file_no")).groupBy("stream_id", "file_no", "parent", "field").agg(F.min("kind").alias("kind"))
    path = W.partitionBy("stream_id", "parent", "field").orderBy("_at")
    placed = held.join(files, ["stream_id", "file_no"])
    return placed.select("*", F.lag("_at").over(path).alias("_before"), F.lag("kind").over(path).alias("_kind_before"), F.lead("_at").over(path).alias("_after"))


def changes(results: DataFrame) -> DataFrame:
    """(stream_id, file_no, change_kind, field_path, new_path): what each file changed against the one before it.

    A field that goes and one of its kind under its parent that comes in the same file, if there is one of each, are a
    rename; other starts and endings are added and removed; a field that stays with another kind is retyped. The first
    file of a stream changes nothing.
    """
    spans = lifespans(results)
    path = F.concat_ws(".", "parent", "field")
    starts = (F.col("_at") > 1) & (F.col("_before").isNull() | (F.col("_before") < F.col("_at") - 1))
    ends = F.col("_next_file").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("_at") + 1))
    retyped = (F.col("_before") == F.col("_at") - 1) & (F.col("_kind_before") != F.col("kind"))
    events = F.array(
        F.when(starts, F.struct(F.lit("added").alias("e"), F.col("file_no").alias("f"))),
        F.when(ends, F.struct(F.lit("removed").alias("e"), F.col("_next_file").alias("f"))),
        F.when(retyped, F.struct(F.lit("retyped").alias("e"), F.col("file_no").alias("f"))),
    )
    log = spans.select("stream_id", "parent", "kind", path.alias("_path"), F.explode(F.array_compact(events)).alias("_x"))
    log = log.select("stream_id", F.col("_x.f").alias("file_no"), F.col("_x.e").alias("_e"), "parent", "kind", "_path")
    moved = log.where("_e <> 'retyped'").groupBy("stream_id", "file_no", "parent", "kind").agg(
        F.sort_array(F.collect_set(F.when(F.col("_e") == "removed", F.col("_path")))).alias("_gone"),
        F.sort_array(F.collect_set(F.when(F.col("_e") == "added", F.col("_path")))).alias("_come"),
    )  # the fields of one file, a bounded set
    one = (F.size("_gone") == 1) & (F.size("_come") == 1)

    def row(kind: str, field, new="") -> F.Column:
        return F.struct(F.lit(kind).alias("change_kind"), field.alias("field_path"), (F.lit(new) if isinstance(new, str) else new).alias("new_path"))

    renamed = F.array(row("renamed", F.get("_gone", F.lit(0)), F.coalesce(F.get("_come", F.lit(0)), F.lit(""))))
    apart = F.concat(F.transform("_gone", lambda p: row("removed", p)), F.transform("_come", lambda p: row("added", p)))
    moved = moved.select("stream_id", "file_no", F.explode(F.when(one, renamed).otherwise(apart)).alias("_r")).select("stream_id", "file_no", "_r.*")
    return moved.unionByName(log.where("_e = 'retyped'").select("stream_id", "file_no", F.lit("retyped").alias("change_kind"), F.col("_path").alias("field_path"), F.lit("").alias("new_path")))


def alias_table(changed: DataFrame) -> dict[str, str]:
    """field path -> canonical path, from all renames of all streams: the name of the family that no rename led to, or
    else the first in alphabetical order. The table is as long as the list of distinct field names."""
    pairs = changed.where("change_kind = 'renamed'").groupBy("field_path", "new_path").count().collect()
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    came = {}
    for old, new, n in sorted(map(tuple, pairs)):
        came[new] = came.get(new, 0) + n
        came[old] = came.get(old, 0) - n
        a, b = root(old), root(new)
        if a != b:
            up[max(a, b)] = min(a, b)
    family: dict[str, list[str]] = {}
    for x in list(up):
        family.setdefault(root(x), []).append(x)
    return {x: min(xs, key=lambda y: (came[y], y)) for xs in family.values() for x in xs}


def field_types(results: DataFrame, aliases: dict[str, str]) -> dict[str, str]:
    """canonical path -> boolean, double or string: the one type that holds every kind the field had."""
    spans = fields_of(results.select("payload"), ())
    kinds = spans.select(F.concat_ws(".", "parent", "field").alias("p"), "kind").distinct().collect()
    seen: dict[str, set[str]] = {}
    for p, kind in kinds:
        seen.setdefault(aliases.get(p, p), set()).add(kind)
    one = {"boolean": "boolean", "number": "double"}
    return {p: one.get(next(iter(k)), "string") if len(k) == 1 else "string" for p, k in sorted(seen.items())}


def _canonical(results: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """One row per result and canonical path held: `cells`, its (path, value) pairs in the order of preference: the
    canonical name before the others."""
    once = results.where("result_id is not null").dropDuplicates(["result_id"])
    long = fields_of(once, ("result_id", "stream_id", "file_no"), values=True).withColumn("_from", F.concat_ws(".", "parent", "field"))
    to = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.col("_from")], F.col("_from")) if aliases else F.col("_from")
    cell = F.struct((F.col("_from") != F.col("_p")).alias("other"), F.col("_from").alias("path"), "value")
    held = long.withColumn("_p", to).groupBy("result_id", "stream_id", "file_no", "_p")
    return held.agg(F.array_sort(F.collect_set(cell)).alias("cells"))  # the names of one field


def collisions(results: DataFrame) -> DataFrame:
    """(result_id, stream_id, file_no, field_path, used, left_out): results that hold a field under several of its names
    with different values. The table uses the canonical name's; what it leaves out is reported here."""
    cells = _canonical(results, alias_table(changes(results))).where(F.size("cells") > 1)
    show = lambda c: F.concat(c["path"], F.lit("="), c["value"])
    first = F.get("cells", F.lit(0))
    out = cells.withColumn("_out", F.filter(F.slice("cells", 2, F.size("cells")), lambda c: c["value"] != first["value"])).where(F.size("_out") > 0)
    return out.select("result_id", "stream_id", "file_no", F.col("_p").alias("field_path"), show(first).alias("used"), F.transform("_out", show).alias("left_out"))


def consistent_table(results: DataFrame) -> DataFrame:
    """(result_id, stream_id, file_no, one column per canonical field): every readable result, once, under one schema.

    The casts are generated from the alias table and the catalogue of kinds; a field that changed its type is text. A
    result that holds a field under several names gives the value of the canonical name, or of the first name in
    alphabetical order; `collisions` reports the others.
    """
    once = results.where("result_id is not null").dropDuplicates(["result_id"])
    aliases = alias_table(changes(results))
    types = field_types(results, aliases)
    held = _canonical(results, aliases).select("result_id", "_p", F.get("cells", F.lit(0))["value"].alias("value"))
    cells = [F.max(F.when(F.col("_p") == p, F.col("value"))).try_cast(t).alias(p.replace(".", "__")) for p, t in types.items()]
    wide = held.groupBy("result_id").agg(*cells) if cells else held.select("result_id").distinct()
    return once.select("result_id", "stream_id", "file_no").join(wide, "result_id", "left")
