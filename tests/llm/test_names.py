"""p5: names typed freely, against Levenshtein distances computed plainly."""

import random

import numpy as np
import pytest

from tarsus.llm import names

RNG = random.Random(3)
ENTRIES = "name string, scientific boolean, taxon_id string"


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def word(n):
    return "".join(RNG.choice("abcdeo ") for _ in range(n))


def test_tree_returns_every_entry_within_the_limit():
    entries = list(dict.fromkeys(word(RNG.randint(1, 80)) for _ in range(150))) + ["ωλκ" * 5, "".join(map(chr, range(0x4E00, 0x4E50)))]
    queries = [word(RNG.randint(0, 68)) for _ in range(20)] + [e[1:] + "ab" for e in entries[:20]]
    tree = names.BKTree(entries)
    limits = np.array([RNG.randint(0, 5) for _ in queries])
    for q, limit, found in zip(queries, limits, tree.search(queries, limits)):
        assert sorted((d, tree.strings[n]) for d, n in found) == sorted((d, e) for e in entries if (d := plain(q, e)) <= limit)
    assert names.BKTree([]).search(["a"], np.array([3])) == [[]]
    assert all(names.edit_distance(a, b) == plain(a, b) for a in queries for b in entries[:5])


@pytest.mark.parametrize(
    "typed,reading",
    [
        ("0181.Fiomtromskic_Sedgellark", "fiomtromskicsedgellark"), ("mudstalker, glultbreskan", "glultbreskanmudstalker"), ("Lagoonstilt, Teimlaskbren - adult male", "teimlaskbrenlagoonstilt"),
        ("prob. 135.Cambresgenic_Willowflit", "cambresgenicwillowflit"), ("bird: Ashwing, \tCiltfurflaese", "ciltfurflaeseashwing"), ("Brèîngültflîs páskbîömálîs", "breingultflispaskbiomalis"),
        ("V. soaltfleiicola?", "v soaltfleiicola"), ("Genera\xa0novifer (Author, 1826)", "generanovifer"), ("Genera novifer subsp [2]", "generanovifer"), ("GENERA NOVIFER (juv.)", "generanovifer"), ("ßtraße Øre", "sstrasseore"),
    ],
)
def test_readings(typed, reading):
    assert reading in names.readings(typed)


@pytest.mark.parametrize("typed", ["", " ", "???", "Draelruus (genus)", "Rupraskus sp", "Vaunsaenvrais spec.", "duck sp.", "12", "V."])
def test_no_reading(typed):
    assert names.readings(typed) == []


def found(spark, typed, entries, **more):
    df = spark.createDataFrame([(t,) for t in typed], "text string")
    return {r.text: (r.distance, r.taxa) for r in names.best_matches(df, spark.createDataFrame(entries, ENTRIES), **more).collect()}


ALL = [("Skemvaerplaor neiklaumifer", True, "t1"), ("Northern Traurkboanen Shorebill", False, "t2"), ("Southern Traurkboanen Shorebill", False, "t3"), ("Foltmundor brelklarkalis", True, "t4"), ("Feltmandor brelklarkalis", True, "t5")]


@pytest.mark.parametrize("shard_entries", [20_000, 2])
def test_matches(spark, shard_entries):
    got = found(spark, ["skemvaerplaorneiklaumifer", "Skemvearplaor neiklumifer female", "Northrn Traurkboanen Shorebill", "F. brelklarkalis", "S. neiklaumifer", "Skemvaerplaor", "Else otherwise", None, "", "x" * 100_000], ALL, shard_entries=shard_entries)
    assert got == {
        "skemvaerplaorneiklaumifer": (0, ["t1"]), "Skemvearplaor neiklumifer female": (3, ["t1"]), "Northrn Traurkboanen Shorebill": (1, ["t2"]), "F. brelklarkalis": (0, ["t4", "t5"]), "S. neiklaumifer": (0, ["t1"]),
    }


@pytest.mark.parametrize("shard_entries", [20_000, 1])
def test_length_script_and_shards_change_nothing(spark, shard_entries):
    long, many, greek = "Skem" + "vaerplaor" * 8, "One two three four five six seven eight", "Σπίνος ο κοινός"
    entries = [(long, False, "t1"), (many, False, "t2"), (greek, False, "t3"), ("Northern lark", False, "a"), ("Northern lark song finch", False, "b")]
    got = found(spark, [long, long[:-1] + "x", many.upper(), "Σπινος ο κοινοσ", "northern lark song finch", "northern lark, male", "word " * 20_000], entries, shard_entries=shard_entries)
    assert got == {
        long: (0, ["t1"]), long[:-1] + "x": (1, ["t1"]), many.upper(): (0, ["t2"]), "Σπινος ο κοινοσ": (0, ["t3"]), "northern lark song finch": (0, ["b"]), "northern lark, male": (0, ["a"]),
    }


def test_resolve(spark, rows):
    cases = spark.createDataFrame([("sample", 1, "Skemvaerplaor neiklaumifer"), ("sample", 1, "Skemvaerplaor neiklaumifer"), ("sample", 2, None), ("override", 3, " "), ("wetland", 4, "F. brelklarkalis"), (None, None, "x")], "entry_kind string, entry_id bigint, text string")
    got = names.resolve(cases, spark.createDataFrame(ALL, ENTRIES))
    assert rows(got.select("entry_id", "taxon_id")) == [(1, "t1"), (2, "none"), (3, "none"), (4, "none")]
    assert sum(r.entries for r in names.unmatched(got).collect()) == 3
    assert names.resolve(cases.limit(0), spark.createDataFrame([], ENTRIES)).count() == 0


def test_cases_and_reference(spark, samples, rows):
    o = spark.createDataFrame([(1, "Aba bab", "Abab lark", "BN1"), (2, "Cdc dcd", None, None), (3, None, None, " ")], "override_id bigint, source_scientific_name string, source_common_name string, birdnet_id string")
    w = spark.createDataFrame([(5, None, "Efe fef", None)], "source_species_id bigint, source_scientific_name string, source_common_name string, birdnet_id string")
    t = spark.createDataFrame([("birdnet:BN9", "Ghg hgh", "Ghgh lark")], "taxon_id string, scientific_name string, common_name string")
    s = samples([{"record_id": 1, "raw_label": "x"}, {"record_id": 2, "raw_label": "y", "taxon_id": "birdnet:BN1"}, {"record_id": 3, "raw_label": "z", "taxon_id": "unknown"}])
    assert rows(names.open_cases(s, o, w).select("entry_kind", "entry_id")) == [("override", 2), ("override", 3), ("sample", 1), ("sample", 3), ("wetland", 5)]
    assert rows(names.reference_names(t, o, w).select("name", "taxon_id")) == [("Aba bab", "birdnet:BN1"), ("Abab lark", "birdnet:BN1"), ("Ghg hgh", "birdnet:BN9"), ("Ghgh lark", "birdnet:BN9")]
