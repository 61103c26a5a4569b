"""b-bit MinHash: signatures of low bits, band candidates, collision-corrected similarity, and look-alike groups.

A 64-bit perceptual hash is the set {(i, bit i)} of 64 elements out of 128; two hashes that differ in d bits have the
resemblance R = (64 - d) / (64 + d). Independent permutations of the 128 elements give minima, of which the lowest
three bits are retained. Runs of r retained minima form L bands; hashes that agree on a band are candidates. Candidates
are estimated from their packed signatures by bit counts, corrected for the chance that unequal minima share their low
bits, and those estimated near enough are verified bit by bit.

r follows the number of hashes so that a hash meets a bounded number of unlike ones a band, and L follows r so that a
pair at the very threshold is missed with a chance of MISS at most (nearer pairs far more rarely). `lossless_links`
finds every link by another way, to report what the bands miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.functions.fields import hash64
from tarsus.llm.components import connected_components
from tarsus.runtime import materialize, ship

LOW_BITS = 3
PACKED = 64 // LOW_BITS  # minima to a word
WORDS = 2  # of the signature that candidates are estimated from
MISS = 1e-5  # chance to miss a pair at the threshold
UNLIKE = 32  # unlike hashes that one meets in a band, about
TASK_ROWS = 1_000_000
HOT = 20_000  # rows of a bucket that are compared in one task
SKEW_SHARE = 64  # hot buckets are known from every 64th value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def resemblance(bits: int) -> float:
    """Of two hashes that differ in so many bits."""
    return (64 - bits) / (64 + bits)


def chance(b: int = LOW_BITS, share: float = 0.5) -> float:
    """The probability that unequal minima share their low b bits, for sets that hold `share` of the universe each."""
    return share * (1 - share) ** (2**b - 1) / (1 - (1 - share) ** (2**b))


def agree_at(bits: int, b: int = LOW_BITS) -> float:
    """The probability that the retained minima of two hashes agree."""
    return chance(b) + (1 - chance(b)) * resemblance(bits)


def band_plan(n: int, max_bits: int, miss: float = MISS, unlike: int = UNLIKE) -> tuple[int, int]:
    """(minima a band, bands) for n hashes."""
    width = max(2, round(math.log(max(n, 1) / unlike) / -math.log(agree_at(32)))) if n > unlike else 2
    return width, math.ceil(math.log(miss) / math.log(1 - agree_at(max_bits) ** width))


def least_agreement(max_bits: int, k: int, miss: float = MISS / 10) -> int:
    """The most places that may be asked to agree so that a pair at the threshold is lost with that chance at most."""
    p, tail = agree_at(max_bits), 0.0
    for m in range(k + 1):
        tail += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > miss:
            return m
    return k


@cache
def rank_tables(k: int, seed: int = 7) -> np.ndarray:
    """(k, 8, 256): the least rank under permutation i of the elements that byte j brings with each of its values."""
    rng = np.random.default_rng(seed)
    rank = np.argsort(rng.random((k, 128)), axis=1).astype(np.uint8)
    bit = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1  # value, place
    out = np.empty((k, 8, 256), np.uint8)
    for j in range(8):
        out[:, j, :] = rank[:, (2 * (8 * j + np.arange(8))[None, :] + bit)].min(axis=2)
    return out


def minima(values: np.ndarray, k: int, seed: int = 7, first: int = 0) -> np.ndarray:
    """(k - first, n): the retained low bits of minima number first to k - 1 of 64-bit values."""
    tables = rank_tables(k, seed)
    parts = [((values >> np.int64(8 * j)) & 255).astype(np.intp) for j in range(8)]
    out = np.empty((k - first, len(values)), np.uint8)
    for i in range(first, k):
        least = tables[i, 0][parts[0]]
        for j in range(1, 8):
            np.minimum(least, tables[i, j][parts[j]], out=least)
        out[i - first] = least & ((1 << LOW_BITS) - 1)
    return out


def packed(values: np.ndarray, seed: int = 7) -> np.ndarray:
    """(WORDS, n): the signature's retained bits, PACKED minima to a word."""
    low = minima(values, WORDS * PACKED, seed).astype(np.uint64)
    out = np.zeros((WORDS, len(values)), np.uint64)
    for i in range(WORDS * PACKED):
        out[i // PACKED] |= low[i] << np.uint64(LOW_BITS * (i % PACKED))
    return out


def band_keys(values: np.ndarray, width: int, bands: int, seed: int = 7) -> np.ndarray:
    """(bands, n): a 64-bit key of each band's minima and its number."""
    tables_end = width * bands
    out = np.empty((bands, len(values)), np.uint64)
    low = minima(values, tables_end, seed)
    for band in range(bands):
        key = np.full(len(values), band + 1, np.uint64)
        for i in range(width):
            key = (key << np.uint64(LOW_BITS)) ^ low[band * width + i] ^ (key >> np.uint64(61)) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[band] = key ^ (key >> np.uint64(29))
    return out.view(np.int64)


def bucket_links(key: np.ndarray, value: np.ndarray, max_bits: int, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, agreeing places) of the linked pairs a < b within equal keys: estimated from the signatures, then verified."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    after = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
    keep = np.searchsorted(key, key, side="right") - np.searchsorted(key, key) > 1
    value, after = value[keep], after[keep]
    sig, least = packed(value, seed), least_agreement(max_bits, WORDS * PACKED)
    lane = np.uint64(sum(1 << LOW_BITS * j for j in range(PACKED)))
    rows, step = np.arange(len(value)), 1
    while len(rows := rows[after[rows] >= step]):
        for at in range(0, len(rows), 1 << 18):
            i = rows[at : at + (1 << 18)]
            differ = np.zeros(len(i), np.int64)
            for w in sig:
                x = w[i] ^ w[i + step]
                differ += np.bitwise_count((x | (x >> np.uint64(1)) | (x >> np.uint64(2))) & lane)
            near = WORDS * PACKED - differ >= least
            i, same = i[near], WORDS * PACKED - differ[near]
            true = np.bitwise_count((value[i] ^ value[i + step]).view(np.uint64)) <= max_bits
            i, same = i[true], same[true]
            different = value[i] != value[i + step]
            if len(i):
                yield value[i][different], value[i + step][different], same[different]
        step += 1


def set_signature(elements: Column, k: int = 128, b: int = 2, seed: int = 7) -> Column:
    """array<bigint>: the low b bits of the minima of k independent permutations, packed 64 // b to a word.

    Null elements are ignored; a set that is null or empty gives null.
    """
    each = 64 // b
    elements = F.filter(elements, lambda e: e.isNotNull())

    def low(i: int) -> Column:
        return F.array_min(F.transform(elements, lambda e: F.xxhash64(e, F.lit(seed), F.lit(i)))).bitwiseAND(F.lit((1 << b) - 1))

    words = []
    for at in range(0, k, each):
        word = F.lit(0).cast("bigint")
        for j, i in enumerate(range(at, min(k, at + each))):
            word = word.bitwiseOR(F.shiftleft(low(i), j * b))
        words.append(word)
    return F.when(F.size(elements) > 0, F.array(*words))


def agreement(x: Column, y: Column, k: int, b: int) -> Column:
    """Share of the k places of b bits at which two packed signatures agree, by bit counts."""
    lane = _signed(sum(1 << j * b for j in range(64 // b)))

    def differing(u: Column, v: Column) -> Column:
        d = u.bitwiseXOR(v)
        folded = d
        for s in range(1, b):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, s))
        return F.bit_count(folded.bitwiseAND(F.lit(lane)))

    total = F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, n: s + n)
    return 1 - total / F.lit(float(k))


def corrected(p: Column, b: int) -> Column:
    """Resemblance from the agreement of independent b-bit minima of large universes: chance agrees in 2^-b of the rest."""
    c = 2.0**-b
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), (p - c) / (1 - c)))


def linked_values(values: DataFrame, col: str, max_bits: int = 4, seed: int = 7, hot: int = HOT) -> DataFrame:
    """(a, b, resemblance): pairs a < b of distinct 64-bit values that differ in at most max_bits bits, with the
    resemblance estimated from their signatures. Values have to be distinct; nulls are ignored.

    Rows of a band travel by their key, and a task compares the buckets it gets without writing their pairs. A bucket of
    more than `hot` rows, about, is cut by a hash of the value into chunks, and every two chunks of it meet in a task of
    their own. Chunks are told from the counts of every 64th value, which decide the way and lose nothing.
    """
    spark = values.sparkSession
    ship(spark)
    source = values.where(F.col(col).isNotNull()).select(F.col(col).cast("bigint").alias("_s"))
    n = source.count()
    width, bands = band_plan(n, max_bits)

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = b["_s"].to_numpy()
                yield pd.DataFrame({"_key": band_keys(v, width, bands, seed).ravel(), "_s": np.tile(v, bands)})

    keyed = source.mapInPandas(banded, "_key bigint, _s bigint")
    share = max(1, min(SKEW_SHARE, hot // 16))
    sampled = source.where(F.pmod(F.xxhash64("_s", F.lit(seed)), F.lit(share)) == 0).mapInPandas(banded, "_key bigint, _s bigint")
    large = materialize(sampled.groupBy("_key").agg((F.count(F.lit(1)) * share).alias("_n")).where(F.col("_n") > hot))
    if not large.isEmpty():
        cut = large.select("_key", F.ceil(F.col("_n") / hot).cast("int").alias("_chunks"))
        chunk = F.pmod(F.xxhash64("_s"), F.col("_chunks")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda j: F.xxhash64("_key", F.least(chunk, j), F.greatest(chunk, j)))
        keyed = keyed.join(cut, "_key", "left").select(F.explode(F.when(F.col("_chunks").isNull(), F.array("_key")).otherwise(met)).alias("_key"), "_s")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["_key"].to_numpy(), b["_s"].to_numpy()) for b in batches]
        if parts:
            for a, b, same in bucket_links(*map(np.concatenate, zip(*parts)), max_bits, seed):
                yield pd.DataFrame({"a": a, "b": b, "_same": same})

    tasks = max(spark.sparkContext.defaultParallelism, -(-n * bands // TASK_ROWS))
    links = keyed.repartition(tasks, "_key").mapInPandas(compared, "a bigint, b bigint, _same int").distinct()
    share = F.col("_same") / F.lit(float(WORDS * PACKED))
    return links.select("a", "b", F.greatest(F.lit(0.0), (share - chance()) / (1 - chance())).alias("resemblance"))


def lossless_links(values: DataFrame, col: str, max_bits: int = 4) -> DataFrame:
    """(a, b): the same pairs without MinHash, for an audit: two values that differ in at most max_bits bits agree on one
    of max_bits + 1 blocks of their bits, and a pair is kept at the first block it shares."""
    blocks = max_bits + 1
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [_signed((1 << hi) - (1 << lo)) for lo, hi in zip(cut, cut[1:])]
    rows = values.where(F.col(col).isNotNull()).select(F.col(col).alias("a"), F.posexplode(F.array(*[F.col(col).bitwiseAND(F.lit(m)) for m in masks])).alias("_at", "_k"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, m in enumerate(masks):
        earlier = earlier | ((F.col("_at") > i) & (x.bitwiseAND(F.lit(m)) == 0))
    pairs = rows.join(rows.withColumnRenamed("a", "b"), ["_at", "_k"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits) & ~earlier)
    return pairs.select("a", "b")


def link_audit(records: DataFrame, hash_col: str = "phash", max_bits: int = 4) -> DataFrame:
    """One row: the links between different hashes (`links`), those that the bands found, lost and invented."""
    values = materialize(records.select(hash64(F.col(hash_col)).alias("_h")).where("_h is not null").distinct())
    found = linked_values(values, "_h", max_bits).select("a", "b", F.lit(1).alias("_f"))
    every = lossless_links(values, "_h", max_bits).select("a", "b", F.lit(1).alias("_e"))
    both = every.join(found, ["a", "b"], "full")
    return both.agg(F.count("_e").alias("links"), F.count("_f").alias("found"), F.count_if(F.col("_f").isNull()).alias("lost"), F.count_if(F.col("_e").isNull()).alias("invented"))


def look_alike_groups(
    records: DataFrame, id_col: str = "record_id", hash_col: str = "phash", image_cols: tuple[str, ...] = ("dataset_id", "source_sample_id"), max_bits: int = 4
) -> DataFrame:
    """(group_record_id, record_id): the records of every group of look-alikes that holds at least two images.

    Records are linked if their hashes differ in at most max_bits bits, and grouped by connection. An id that arrives
    several times counts once; rows without an id, or with a hash that is missing, unreadable or uniform, belong to
    no group; null image columns are values of their own; images are told apart by a 64-bit hash of their columns; other
    columns are ignored. Copies of one hash are folded to one row before any pairing, and unfolded at the end.
    """
    image = F.xxhash64(*[x for c in image_cols for x in (F.col(c).isNull(), F.col(c).cast("string"))])
    rows = records.select(F.col(id_col).alias("_id"), hash64(F.col(hash_col)).alias("_h"), image.alias("_image")).where("_id is not null and _h is not null")
    rows = materialize(rows)
    values = materialize(rows.groupBy("_h").agg(F.min("_id").alias("_first"), F.min("_image").alias("_lo"), F.max("_image").alias("_hi")))
    comps = materialize(connected_components(linked_values(values, "_h", max_bits)).select(F.col("node").alias("_h"), "component"))
    tied = comps.join(values, "_h").groupBy("component").agg(F.min("_first").alias("group_record_id"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    tied = comps.join(tied.where("_lo <> _hi"), "component").select("_h", "group_record_id")
    own = values.where("_lo <> _hi").join(comps, "_h", "left_anti").select("_h", F.col("_first").alias("group_record_id"))
    return rows.join(tied.unionByName(own), "_h").select("group_record_id", F.col("_id").alias("record_id")).distinct()
