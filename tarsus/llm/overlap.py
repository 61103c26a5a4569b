"""Records of evaluation splits that occur again in train: winnowing fingerprints over the bits of perceptual hashes.

The bit string of a hash is cut into windows (blocks). In every window the rolling hashes of its k-grams are scrambled
and the smallest is selected, with its place: a seed. Equal windows select equal seeds. Alignments of hashes are
ungapped, so seeds are collinear if both keep their places; a chain of two collinear seeds is what records of
different splits are joined on. With 6 windows and up to 4 differing bits two windows at least are untouched, so every
true pair shares a chain: selection loses nothing. Chained pairs are extended over the whole string by counting the
differing bits, which is the exact alignment, and kept up to max_bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsus.functions.fields import digest256, hash64, split_name
from tarsus.runtime import materialize

SCRAMBLE = 0x9E37
SKEW_SHARE = 64


def seeds(bits: Column, windows: int = 6, k: int = 9) -> list[Column]:
    """The selected k-gram of every window as an int: place and gram of the smallest scrambled rolling hash."""
    out = []
    cut = [64 * i // windows for i in range(windows + 1)]
    for lo, hi in zip(cut, cut[1:]):
        grams = []
        for at in range(lo, max(lo, hi - k) + 1):
            gram = F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << min(k, hi - lo)) - 1))
            order = (gram * SCRAMBLE + 12345).bitwiseAND(F.lit(0xFFFF))
            grams.append(order * (1 << 20) + at * (1 << 12) + gram)
        best = F.least(*grams) if len(grams) > 1 else grams[0]
        out.append(best.bitwiseAND(F.lit((1 << 20) - 1)))
    return out


def chains(rows: DataFrame, bits: str, windows: int, max_bits: int, k: int) -> DataFrame:
    """Every row with one _key for each choice of windows - max_bits seeds."""
    selected = rows.withColumn("_seeds", F.array(*seeds(F.col(bits), windows, k)))
    take = windows - max_bits
    keys = [F.xxhash64(F.lit(n), *[F.col("_seeds")[i] for i in c]) for n, c in enumerate(combinations(range(windows), take))]
    return selected.withColumn("_key", F.explode(F.array(*keys))).drop("_seeds")


def matching_values(train: DataFrame, held: DataFrame, max_bits: int = 4, windows: int = 6, k: int = 9, hot: int = 4096) -> DataFrame:
    """(_t, _e): pairs of a train and a held-out value, each in column _h and distinct, that differ in up to max_bits bits.

    The two sides are joined on their chains. A chain whose sides would pair to more than about hot x hot candidates is
    cut finer: its rows get the chains of twice the windows and two with max_bits taken away, which are again complete.
    Such chains are told from the counts of every 64th value, which decide the way and lose nothing.
    """
    both = train.select("_h", F.lit(True).alias("_train")).unionByName(held.select("_h", F.lit(False).alias("_train")))
    keyed = chains(both, "_h", windows, max_bits, k)
    share = max(1, min(SKEW_SHARE, hot // 16))
    sampled = chains(both.where(F.pmod(F.xxhash64("_h"), F.lit(share)) == 0), "_h", windows, max_bits, k)
    counts = sampled.groupBy("_key").agg(F.count_if("_train").alias("_nt"), F.count_if(~F.col("_train")).alias("_ne"))
    large = materialize(counts.where(F.col("_nt") * F.col("_ne") * share * share > hot * hot).select("_key"))

    def joined(rows: DataFrame) -> DataFrame:
        t = rows.where("_train").select("_key", F.col("_h").alias("_t"))
        e = rows.where("not _train").select("_key", F.col("_h").alias("_e"))
        return t.join(e, "_key").where(F.bit_count(F.col("_t").bitwiseXOR(F.col("_e"))) <= max_bits).select("_t", "_e")

    if large.isEmpty():
        return joined(keyed).distinct()
    out = joined(keyed.join(large, "_key", "left_anti"))
    fine = keyed.join(large, "_key", "left_semi").select("_h", "_train", F.col("_key").alias("_outer"))
    fine = chains(fine, "_h", 2 * max_bits + 2, max_bits, 6).withColumn("_key", F.xxhash64("_outer", "_key"))
    return out.unionByName(joined(fine)).distinct()


def _prepared(records: DataFrame, id_col: str, hash_col: str, sha_col: str, split_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = records.select(
        F.col(id_col).alias("_id"), hash64(F.col(hash_col)).alias("_h"), digest256(F.col(sha_col)).alias("_d"), split_name(F.col(split_col)).alias("_split"), *[F.col(c).alias(f"_k_{c}") for c in keep]
    )
    return rows.where("_id is not null and _split is not null")


def cross_split_pairs(
    records: DataFrame, id_col: str = "record_id", hash_col: str = "phash", sha_col: str = "sha256", split_col: str = "source_split", max_bits: int = 4
) -> DataFrame:
    """(record_id_a, record_id_b): pairs of a train and a held-out record with one digest or nearly one hash, a < b.

    Rows without an id or a split take no part, a missing or placeholder digest or hash matches nothing, an id that
    arrives twice counts once, other columns are ignored. Values are matched once however many records hold them and
    unfolded at the end; both unfolding joins split skewed keys.
    """
    rows = materialize(_prepared(records, id_col, hash_col, sha_col, split_col).select("_id", "_h", "_d", (F.col("_split") == "train").alias("_train")))
    t, e = rows.where("_train"), rows.where("not _train")
    values = materialize(rows.where("_h is not null").groupBy("_h", "_train").agg(F.count(F.lit(1)).alias("_n")))
    near = materialize(matching_values(values.where("_train").select("_h"), values.where("not _train").select("_h"), max_bits))
    a = near.join(t.select(F.col("_h").alias("_t"), F.col("_id").alias("_x")), "_t")
    b = a.join(e.select(F.col("_h").alias("_e"), F.col("_id").alias("_y")), "_e").select("_x", "_y")
    same = t.where("_d is not null").select("_d", F.col("_id").alias("_x")).join(e.where("_d is not null").select("_d", F.col("_id").alias("_y")), "_d").select("_x", "_y")
    pairs = b.unionByName(same).where("_x <> _y")
    return pairs.select(F.least("_x", "_y").alias("record_id_a"), F.greatest("_x", "_y").alias("record_id_b")).distinct()


def _scored(records: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, shared): every record of a split once, with its pairs by digest and by hash and the least distance of a
    hash of the other side; and the pairs that match by both, as negative counts under each of their two places."""
    rows = _prepared(records, "record_id", "phash", "sha256", "source_split", ("dataset_id",)).dropDuplicates(["_id"])
    rows = materialize(rows.withColumn("_train", F.col("_split") == "train"))
    bits, place = F.bit_count(F.col("_t").bitwiseXOR(F.col("_e"))), ("_split", "_k_dataset_id")

    # digests: counts of both sides; a digest that only one side holds is dropped from the rows
    digests = rows.where("_d is not null").groupBy("_d").agg(F.count_if("_train").alias("_nt"), F.count_if(~F.col("_train")).alias("_ne")).where("_nt > 0 and _ne > 0")
    other = F.coalesce(F.when(F.col("_train"), F.col("_ne")).otherwise(F.col("_nt")), F.lit(0))
    rows = materialize(rows.join(digests, "_d", "left").select("_id", *place, "_train", "_h", F.when(F.col("_nt") > 0, F.col("_d")).alias("_d"), other.alias("_pairs_d")))

    # hashes: counts of the other side's values near each value
    sizes = materialize(rows.where("_h is not null").groupBy("_h", "_train").agg(F.count(F.lit(1)).alias("_n")))
    near = materialize(matching_values(sizes.where("_train").select("_h"), sizes.where("not _train").select("_h"), max_bits)).withColumn("_bits", bits)
    sides = near.select(F.col("_e").alias("_h"), F.lit(False).alias("_train"), F.col("_t").alias("_o"), "_bits").unionByName(near.select(F.col("_t").alias("_h"), F.lit(True).alias("_train"), F.col("_e").alias("_o"), "_bits"))
    by_hash = sides.join(sizes.select(F.col("_h").alias("_o"), (~F.col("_train")).alias("_train"), "_n"), ["_o", "_train"]).groupBy("_h", "_train").agg(F.sum("_n").alias("_pairs_h"), F.min("_bits").alias("_bits"))
    scored = rows.join(by_hash, ["_h", "_train"], "left").withColumn("_pairs", F.col("_pairs_d") + F.coalesce("_pairs_h", F.lit(0)))

    # pairs by both, which the two sums hold twice, as rows of their own
    shared = rows.where("_h is not null and _d is not null").groupBy("_train", *place, "_h", "_d").agg(F.count(F.lit(1)).alias("_n"))
    t = shared.where("_train").select("_d", F.col("_h").alias("_t"), F.col("_n").alias("_nt"), F.struct(*place).alias("_at"))
    e = shared.where("not _train").select("_d", F.col("_h").alias("_e"), F.col("_n").alias("_ne"), F.struct(*place).alias("_ae"))
    both = t.join(e, "_d").where(bits <= max_bits).select(F.explode(F.array("_at", "_ae")).alias("_p"), (-F.col("_nt") * F.col("_ne")).alias("_pairs")).select("_p.*", "_pairs")

    return scored, both


def _cover() -> Column:
    """The share of a record's bits that the best matching value of the other side covers, 1 for an equal digest."""
    return F.when(F.col("_pairs_d") > 0, 1.0).when(F.col("_pairs_h") > 0, 1 - F.col("_bits") / 64.0)


def record_coverage(records: DataFrame, max_bits: int = 4) -> DataFrame:
    """(record_id, source_split, dataset_id, by_digest, by_hash, coverage) of the records that occur on the other side of
    train: how many records there have their digest, how many nearly their hash, and the share of its bits covered."""
    scored, _ = _scored(records, max_bits)
    out = scored.withColumn("coverage", _cover()).where("coverage is not null")
    by_hash = F.coalesce("_pairs_h", F.lit(0)).cast("bigint").alias("by_hash")
    return out.select(F.col("_id").alias("record_id"), F.col("_split").alias("source_split"), F.col("_k_dataset_id").alias("dataset_id"), F.col("_pairs_d").alias("by_digest"), by_hash, "coverage")


def overlap_report(records: DataFrame, max_bits: int = 4) -> DataFrame:
    """Per split and dataset: records, records that occur on the other side, pairs, and mean coverage of their bits.

    The sides are train and held-out; a pair of `cross_split_pairs` counts once under the split and dataset of each of
    its two records.
    """
    scored, both = _scored(records, max_bits)
    cover = _cover()
    return scored.drop("_id").unionByName(both, allowMissingColumns=True).groupBy(F.col("_split").alias("source_split"), F.col("_k_dataset_id").alias("dataset_id")).agg(
        F.count("_train").alias("records"),
        F.count(cover).alias("overlapping"),
        F.count_if(F.col("_pairs_d") > 0).alias("same_digest"),
        F.count_if(F.col("_pairs_h") > 0).alias("near_hash"),
        F.sum("_pairs").alias("pairs"),
        F.round(F.avg(cover), 6).alias("mean_coverage"),
    )
