"""Splits that keep related records together, from a persisted table of components.

The component table has one row per key (a group, a taxon, or a record without any): `key`, `component` (the smallest
key it is tied to), `split` and `status`. It is written by one run and taken up by the next: old components keep their split, components that new
records tie together are merged by pointer jumping, merged components whose splits disagree are quarantined (split
null, status quarantined) and stay so in later runs, and new components fill the deficits against the target shares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.functions.fields import group_key, split_name, taxon_key
from tarsus.llm.components import connected_components
from tarsus.runtime import materialize

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
SLOTS = 4096


def keyed_records(records: DataFrame, by: tuple[str, ...] = ("group_id",), id_col: str = "record_id", split_col: str = "source_split") -> DataFrame:
    """(_id, _split, _keys): a record with its canonical keys, null where a key is missing or a placeholder.

    An id that arrives several times counts once. Rows without an id are left out; other columns are ignored.
    """
    canonical = {"group_id": group_key, "taxon_id": taxon_key}
    keys = [F.concat(F.lit(f"{c}="), canonical.get(c, taxon_key)(F.col(c))) for c in by]
    return records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), split_name(F.col(split_col)).alias("_split"), F.array(*keys).alias("_keys"))


def component_table(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(key, component) for every key of the rows, and of the previous table.

    A record ties its keys to each other, `previous` ties its keys to their components; what is connected is merged by
    pointer jumping. Keys that nothing ties to another are components of their own.
    """
    found = rows.select(F.array_compact("_keys").alias("_k")).where(F.size("_k") > 0)
    pairs = found.select(F.col("_k")[0].alias("a"), F.explode("_k").alias("b")).distinct()
    if previous is not None:
        pairs = pairs.unionByName(previous.select(F.col("component").alias("a"), F.col("key").alias("b")))
    return materialize(connected_components(pairs).select(F.col("node").alias("key"), "component"))


def first_key(own: bool = False) -> Column:
    """The first key of a record, which stands for all of them; with `own` a record without any is its own key."""
    key = F.get(F.array_compact("_keys"), F.lit(0))
    return F.coalesce(key, F.concat(F.lit("record="), F.col("_id").cast("string"))) if own else key


def _torn(rows: DataFrame, table: DataFrame, *more: Column) -> DataFrame:
    """(_component, ...) of the components whose records lie in at least two source splits: splits are gathered by key
    before they meet the table, so that no row of a large group travels."""
    seen = [F.max(F.when(F.col("_split") == n, 1).otherwise(0)).alias(f"_in_{n}") for n, _ in SHARES]
    by_key = rows.withColumn("_key", first_key()).where("_key is not null").groupBy("_key").agg(*seen, *more)
    sums = [F.sum(n).alias(n) for n in by_key.columns if n != "_key" and not n.startswith("_in_")]
    placed = by_key.join(table.select(F.col("key").alias("_key"), F.col("component").alias("_component")), "_key")
    out = placed.groupBy("_component").agg(reduce(lambda a, b: a + b, [F.max(f"_in_{n}") for n, _ in SHARES]).alias("_seen"), *sums)
    return out.where("_seen > 1").drop("_seen")


def torn_records(records: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """(record_id): every record of a component whose records lie in at least two source splits.

    Records without a key tie nothing and are never torn. The records come back by a join on their key that splits
    skewed keys.
    """
    rows = materialize(keyed_records(records, by))
    table = component_table(rows)
    keys = table.join(_torn(rows, table).select(F.col("_component").alias("component")), "component", "left_semi").select(F.col("key").alias("_key"))
    return rows.select("_id", first_key().alias("_key")).join(keys, "_key", "left_semi").select(F.col("_id").alias("record_id")).distinct()


def torn_components(records: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """One row per torn component: its number of records in each source split and without one."""
    rows = materialize(keyed_records(records, by).dropDuplicates(["_id"]))
    counts = [F.count_if(F.col("_split") == n).alias(n) for n, _ in SHARES]
    return _torn(rows, component_table(rows), *counts, F.count_if(F.col("_split").isNull()).alias("none")).withColumnRenamed("_component", "component")


def assign_components(sizes: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, held: dict[str, int] | None = None, large: float = 1e-4) -> DataFrame:
    """(component, split) for new components given their sizes: (component, n).

    `held` counts the records that existing components already give to each split. Components of at least the share
    `large` of all records, of which there are at most 1 / large, are dealt out one by one, largest first, each to
    the split with the largest deficit. The others are laid end to end in hash order, and the line is cut where the
    remaining deficits say; a component belongs where its middle falls, so no split misses its target by more than one
    component of less than that share. Hash slots give the offsets: their number is fixed and only their totals come
    to the driver.
    """
    sizes = materialize(sizes)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    have = {s: (held or {}).get(s, 0) for s, _ in shares}
    everything = total + sum(have.values())
    deficit = {s: w * everything - have[s] for s, w in shares}
    big = sizes.where(F.col("n") >= F.lit(max(2.0, large * total)))
    small = sizes.where(F.col("n") < F.lit(max(2.0, large * total)))
    placed = []
    for component, n in sorted(map(tuple, big.select("component", "n").toLocalIterator()), key=lambda x: (-x[1], x[0])):
        s = max(deficit, key=lambda k: deficit[k])
        deficit[s] -= n
        placed.append((component, s))
    schema = "component string, split string"
    dealt = sizes.sparkSession.createDataFrame(placed, schema)
    slotted = small.withColumn("_slot", F.pmod(F.xxhash64("component"), F.lit(SLOTS)))
    totals = dict(map(tuple, slotted.groupBy("_slot").agg(F.sum("n")).collect()))
    starts, at = [], 0
    for slot in range(SLOTS):
        starts.append(at)
        at += totals.get(slot, 0)
    left = {s: max(0.0, d) for s, d in deficit.items()}
    scale = at / (sum(left.values()) or 1)
    start = F.element_at(F.lit(starts), (F.col("_slot") + 1).cast("int"))
    line = W.partitionBy("_slot").orderBy(F.xxhash64("component", F.lit(1)), "component").rowsBetween(W.unboundedPreceding, -1)
    middle = start + F.coalesce(F.sum("n").over(line), F.lit(0)) + F.col("n") / 2
    case, edge = None, 0.0
    for s, _ in shares[:-1]:
        edge += left[s] * scale
        case = F.when(middle < edge, s) if case is None else case.when(middle < edge, s)
    return dealt.unionByName(slotted.select("component", case.otherwise(shares[-1][0]).alias("split")))


def assign_splits(
    records: DataFrame, by: tuple[str, ...] = ("group_id",), shares: tuple[tuple[str, float], ...] = SHARES, previous: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The new split of every record, and the component table to persist for the next run.

    Returns (record_id, component, split, status) and (key, component, split, status). Status is new, kept or quarantined.
    With a `previous` table, every component that holds one of its components keeps that split; where several splits
    meet, or one of them is quarantined already, the component is quarantined and its records get no split. Components
    without records in this run are carried over. Records without any key are components of their own, and keep their
    split as well. An empty table gives empty results.
    """
    rows = materialize(keyed_records(records, by).select("_id", "_keys").dropDuplicates(["_id"]))
    loose = rows.select("_id", F.array(first_key(own=True)).alias("_keys"))  # a record without keys is a key
    table = component_table(rows.unionByName(loose), previous)
    placed = rows.select("_id", first_key(own=True).alias("key")).join(table, "key").select("_id", F.col("component").alias("_component"))
    placed = materialize(placed)
    sizes = placed.groupBy(F.col("_component").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    if previous is None:
        split = materialize(assign_components(sizes, shares)).withColumn("status", F.lit("new"))
    else:
        old = previous.select("key", "split").join(table, "key").groupBy("component")
        old = materialize(old.agg(F.min("split").alias("_lo"), F.max("split").alias("_hi"), F.bool_or(F.col("split").isNull()).alias("_held")))
        agreed = (F.col("_lo") == F.col("_hi")) & ~F.col("_held")
        kept = old.select("component", F.when(agreed, F.col("_lo")).alias("split"), F.when(agreed, "kept").otherwise("quarantined").alias("status"))
        held = dict(map(tuple, sizes.join(kept, "component").where("split is not null").groupBy("split").agg(F.sum("n")).collect()))
        fresh = assign_components(sizes.join(old, "component", "left_anti"), shares, held)
        split = materialize(kept.unionByName(fresh.withColumn("status", F.lit("new"))))
    out = placed.join(split.withColumnRenamed("component", "_component"), "_component")
    out = out.select(F.col("_id").alias("record_id"), F.col("_component").alias("component"), "split", "status")
    return out, table.join(split.select("component", "split", "status"), "component").select("key", "component", "split", "status")


def share_report(assigned: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """(split, target_share, records, actual_share), quarantined records under the split null."""
    counts = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    target = F.create_map(*[F.lit(x) for pair in shares for x in pair])
    return counts.select("split", target[F.coalesce("split", F.lit("-"))].alias("target_share"), "records", (F.col("records") / F.sum("records").over(W.partitionBy(F.lit(1)))).alias("actual_share"))
