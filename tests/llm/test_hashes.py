"""p1, p3, p7: groups of look-alikes, splits of related records, overlaps across splits."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsus.llm import components, minhash, overlap, splits

RNG = random.Random(4)


def near(h, bits):
    for b in RNG.sample(range(64), bits):
        h ^= 1 << b
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def values(n=150):
    base = [RNG.getrandbits(64) for _ in range(n)]
    base += [near(RNG.choice(base), RNG.randint(0, 6)) for _ in range(2 * n)]
    low = [RNG.getrandbits(20) for _ in range(n)]  # share 44 bits: hot buckets
    return sorted({v for v in base + low if v not in (0, 2**64 - 1)})


def linked(vs, t=4):
    return {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(vs) for b in vs[:i] if (a ^ b).bit_count() <= t}


@pytest.mark.parametrize("hot", [minhash.HOT, 16])
def test_linked_values_lose_nothing(spark, hot):
    vs = values()
    df = spark.createDataFrame([(signed(v),) for v in vs] + [(None,)], "v bigint")
    links = minhash.linked_values(df, "v", hot=hot).collect()
    got = [(r.a, r.b) for r in links]
    assert len(got) == len(set(got)) and set(got) == linked(vs) and all(r.resemblance > 0.5 for r in links)
    every = minhash.lossless_links(df, "v").collect()
    assert sorted((r.a, r.b) for r in every) == sorted(linked(vs))


def test_agreement_of_minima_follows_the_formula():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63, 4000)
    for bits in (0, 4, 32):
        flip = np.array([sum(1 << int(i) for i in rng.choice(64, bits, replace=False)) for _ in a], np.uint64).view(np.int64)
        same = (minhash.minima(a, 60) == minhash.minima(a ^ flip, 60)).mean()
        assert abs(same - minhash.agree_at(bits)) < 0.01
    plain = [[min(r[2 * i + (int(v) >> i & 1)] for i in range(64)) & 7 for v in a[:50]] for r in _ranks(5)]
    assert minhash.minima(a[:50], 5).tolist() == plain


def _ranks(k):
    return np.argsort(np.random.default_rng(7).random((k, 128)), axis=1).astype(int).tolist()


def test_bands_miss_a_pair_at_the_threshold_as_seldom_as_asked():
    for n in (100, 10**5, 10**8):
        width, bands = minhash.band_plan(n, 4)
        assert (1 - minhash.agree_at(4) ** width) ** bands <= minhash.MISS and n * minhash.agree_at(32) ** width <= 4 * minhash.UNLIKE
    rng = np.random.default_rng(5)
    a = rng.integers(-(2**63), 2**63, 20_000)
    flip = np.array([sum(1 << int(i) for i in rng.choice(64, 4, replace=False)) for _ in a], np.uint64).view(np.int64)
    assert (minhash.band_keys(a, 9, 30) == minhash.band_keys(a ^ flip, 9, 30)).any(0).mean() > 0.9998


@pytest.mark.parametrize("hot", [4096, 3])
def test_matching_values_lose_nothing(spark, hot):
    vs = values(80)
    t, e = vs[::2], vs[1::2] + vs[:5]
    frame = lambda xs: spark.createDataFrame([(signed(v),) for v in xs], "_h bigint")
    got = {(r._t, r._e) for r in overlap.matching_values(frame(t), frame(sorted(set(e))), hot=hot).collect()}
    assert got == {(signed(a), signed(b)) for a in t for b in e if (a ^ b).bit_count() <= 4}


def test_resemblance_of_signatures(spark):
    df = spark.createDataFrame([(list(range(100)), list(range(20, 120))), (None, [1]), ([], [1])], "a array<int>, b array<int>")
    s = df.select(minhash.set_signature(F.col("a"), 256, 2).alias("x"), minhash.set_signature(F.col("b"), 256, 2).alias("y"))
    got = s.select(minhash.corrected(minhash.agreement(F.col("x"), F.col("y"), 256, 2), 2)).collect()
    assert abs(got[0][0] - 80 / 120) < 0.12 and got[1][0] is None and got[2][0] is None


def test_components(spark, rows):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)] + [(300, 300 + i) for i in range(40)]
    RNG.shuffle(edges)
    got = dict(rows(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, **{300 + i: 300 for i in range(40)}}
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def record(i, h=None, image=None, **more):
    return {"record_id": i, "phash": h, "dataset_id": "d", "source_sample_id": image or f"s{i}", **more}


def test_look_alike_groups(samples, rows):
    h = 0x123456789ABCDEF0
    data = [
        record(5, f"{h:016x}"), record(3, f"0x{h ^ 15:016X}"), record(9, f"{h ^ 15 ^ (15 << 40):016x}"),  # a chain over two links
        record(11, f"{h ^ (31 << 20):016x}"),  # five bits off
        record(1, "0" * 16), record(2, "f" * 16), record(4, "n/a"), record(6, None), record(7, ""), record(None, f"{h:016x}"),
        record(20, "a5a5a5a5a5a5a5a5", "same"), record(21, "a5a5a5a5a5a5a5a5", "same"),  # one image listed twice
        record(30, "5a5a5a5a00000001", "x"), record(31, "5a5a5a5a00000001", None) | {"source_sample_id": None},  # equal hashes, two images
    ]
    got = rows(minhash.look_alike_groups(samples(data + data[:3])))
    assert got == [(3, 3), (3, 5), (3, 9), (30, 30), (30, 31)]
    assert minhash.look_alike_groups(samples([])).count() == 0


def test_a_hash_that_a_third_of_all_rows_hold(samples):
    data = [record(i, "123456789abcdef0") for i in range(2000)] + [record(5000 + i, f"{RNG.getrandbits(64) | 1:016x}") for i in range(500)]
    got = minhash.look_alike_groups(samples(data)).where("group_record_id = 0")
    assert got.count() == 2000


def test_cross_split_pairs(samples, rows):
    h, d = 0x123456789ABCDEF0, "ab" * 32
    data = [
        record(1, f"{h:016x}", source_split="train"), record(2, f"{h ^ 3:016x}", source_split=" VAL "), record(3, f"{h ^ 3:016x}", source_split="unassigned"),
        record(4, None, source_split="test", sha256=f"sha256:{d}"), record(5, "", source_split="trn", sha256=d.upper()), record(6, f"{h:016x}", source_split="tst", sha256="0" * 64),
        record(7, "0" * 16, source_split="train", sha256="0" * 64), record(8, "0" * 16, source_split="test"), record(None, f"{h:016x}", source_split="test"), record(9, f"{h:016x}"),
    ]
    assert rows(overlap.cross_split_pairs(samples(data + data[:4]))) == [(1, 2), (1, 6), (4, 5)]
    assert overlap.cross_split_pairs(samples([])).count() == 0
    report = {(r.source_split, r.dataset_id): r for r in overlap.overlap_report(samples(data + data[:4])).collect()}
    assert report["validation", "d"].overlapping == 1 and report["test", "d"].records == 3 and report["test", "d"].overlapping == 2
    assert report["test", "d"].same_digest == 1 and report["test", "d"].mean_coverage == 1.0
    cover = {r.record_id: (r.by_digest, r.by_hash, r.coverage) for r in overlap.record_coverage(samples(data + data[:4])).collect()}
    assert cover == {1: (0, 2, 1.0), 2: (0, 1, 1 - 2 / 64), 4: (1, 0, 1.0), 5: (1, 0, 1.0), 6: (0, 1, 1.0)}


def test_pairs_against_brute_force(samples):
    vs = values(60)
    split = ["train", "train", "train", "test", "validation", None]
    data = [record(i, f"{RNG.choice(vs):016x}", source_split=RNG.choice(split), sha256=RNG.choice([None, "ab" * 32, "cd" * 32, f"{i:064x}"])) for i in range(300)]
    want = set()
    for a in data:
        for b in data:
            if a["source_split"] == "train" and b["source_split"] in ("test", "validation"):
                same = a["sha256"] and a["sha256"] == b["sha256"] and len(set(a["sha256"])) > 1
                if same or (int(a["phash"], 16) ^ int(b["phash"], 16)).bit_count() <= 4:
                    want.add(tuple(sorted((a["record_id"], b["record_id"]))))
    got = [(r[0], r[1]) for r in overlap.cross_split_pairs(samples(data)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_report_counts_the_pairs(samples):
    vs = values(40)
    split, sets = ["train", "train", "train", "test", "validation", None], ["d1", "d2", None]
    data = [record(i, f"{RNG.choice(vs):016x}", source_split=RNG.choice(split), sha256=RNG.choice([None, "ab" * 32, "cd" * 32, f"{i:064x}"]), dataset_id=RNG.choice(sets)) for i in range(300)]
    data += [record(1000 + i, f"{vs[0]:016x}", source_split="train", sha256="ef" * 32) for i in range(200)] + [record(2000, f"{vs[0]:016x}", source_split="test", sha256="ef" * 32)]
    at = {r["record_id"]: (r["source_split"], r["dataset_id"]) for r in data}
    want = Counter(at[i] for p in overlap.cross_split_pairs(samples(data + data[:20])).collect() for i in p)
    got = {(r.source_split, r.dataset_id): r.pairs for r in overlap.overlap_report(samples(data + data[:20])).collect()}
    assert got == {k: want[k] for k in set(at.values()) if k[0]} and got["test", "d"] >= 200


def grouped(i, g, split=None, taxon=None):
    return {"record_id": i, "group_id": g, "source_split": split, "taxon_id": taxon}


def test_torn_records(samples, rows):
    data = [grouped(1, "cam:0001", "train"), grouped(2, "CAM : 1", "test"), grouped(3, "cam%3A1", None), grouped(4, "cam:2", "train"), grouped(5, "cam:2", "trn"), grouped(6, None, "train"), grouped(7, None, "test"), grouped(8, "unknown", "train"), grouped(9, "unknown", "test"), grouped(None, "cam:2", "test")]
    assert rows(splits.torn_records(samples(data + data[:2]))) == [(1,), (2,), (3,)]
    assert rows(splits.torn_components(samples(data + data[:2]))) == [("group_id=cam:1", 1, 0, 1, 1)]
    assert splits.torn_records(samples([])).count() == 0


def test_shares_and_togetherness(samples):
    data = [grouped(i, f"cam:{min(RNG.randint(0, 400), RNG.randint(0, 400))}", None, f"t{RNG.randint(0, 5000)}") for i in range(3000)] + [grouped(5000 + i, None) for i in range(100)]
    for by in (("group_id",), ("group_id", "taxon_id")):
        got = splits.assign_splits(samples(data), by)[0].collect()
        assert len(got) == 3100
        of = {r.record_id: r.split for r in got}
        for key in by:
            groups = defaultdict(set)
            for r in data:
                if r[key]:
                    groups[r[key]].add(of[r["record_id"]])
            assert all(len(s) == 1 for s in groups.values())
        if by == ("group_id",):
            assert abs(sum(s == "train" for s in of.values()) / 3100 - 0.8) < 0.02
    assert splits.assign_splits(samples([]))[0].count() == 0


def test_increments_keep_fill_and_quarantine(samples):
    first = [grouped(i, f"cam:{i}", None) for i in range(60)]
    out, table = splits.assign_splits(samples(first))
    old = {r.component: r.split for r in out.collect()}
    a = next(c for c, s in old.items() if s == "train")
    b = next(c for c, s in old.items() if s == "test")
    ga, gb = (c.split("=")[1] for c in (a, b))
    second = first + [grouped(100, ga, None, "t1"), grouped(101, gb, None, "t1"), grouped(102, "cam:999", None, "t2")]
    got, new = splits.assign_splits(samples(second), ("group_id", "taxon_id"), previous=table)
    by = {r.record_id: r for r in got.collect()}
    assert by[100].status == by[101].status == "quarantined" and by[100].split is None
    assert by[102].status == "new" and by[102].split is not None
    assert all(r.status == "kept" and r.split == old[f"group_id=cam:{i}"] for i, r in by.items() if i < 60 and f"group_id=cam:{i}" not in (a, b))
    assert {r.split for r in new.where(F.col("key").isin(a, b)).collect()} == {None}
    assert splits.share_report(got).where("split is null").first().records == 4


def test_quarantine_outlasts_runs(samples):
    _, table = splits.assign_splits(samples([grouped(i, f"cam:{i}") for i in range(60)]))
    at = {r.split: r.key for r in table.collect()}
    ga, gb = (at[s].split("=")[1] for s in ("train", "test"))
    by = ("group_id", "taxon_id")
    _, table = splits.assign_splits(samples([grouped(100, ga, None, "t1"), grouped(101, gb, None, "t1")]), by, previous=table)
    out, table = splits.assign_splits(samples([grouped(100, ga), grouped(200, "cam:777")]), by, previous=table)
    assert {r.record_id: r.status for r in out.collect()} == {100: "quarantined", 200: "new"}
    _, table = splits.assign_splits(samples([grouped(300, "cam:888")]), by, previous=table)  # none of its records
    of = {r.key: (r.split, r.status) for r in table.collect()}
    assert of[at["train"]] == of[at["test"]] == (None, "quarantined") and len(of) == 63


def test_records_without_a_group_keep_their_split(samples):
    data = [grouped(i, None if i % 2 else f"cam:{i}") for i in range(80)]
    out, table = splits.assign_splits(samples(data))
    again, table = splits.assign_splits(samples(data + [grouped(500 + i, None) for i in range(60)]), previous=table)
    third, _ = splits.assign_splits(samples(data), previous=table)
    first = {r.record_id: r.split for r in out.collect()}
    assert all(first[r.record_id] == r.split for r in again.collect() if r.record_id < 80)
    assert {r.record_id: (r.split, r.status) for r in third.collect()} == {i: (s, "kept") for i, s in first.items()}


def test_ties_through_others_are_torn(samples, rows):
    data = [grouped(1, "cam:1", "train", "t1"), grouped(2, "cam:2", None, "t1"), grouped(3, "cam:2", "test", "t2"), grouped(4, None, "train", "t9")]
    assert rows(splits.torn_records(samples(data))) == [] and rows(splits.torn_records(samples(data), ("group_id", "taxon_id"))) == [(1,), (2,), (3,)]
