import math

import pytest
from pyspark.sql import functions as F

from tarsus.functions import fields, geometry, text, vectors
from tarsus.operators.paired import binomial_p, exact_mcnemar_p, mcnemar_p


def one(spark, column, **values):
    names = list(values)
    ddl = {str: "string", int: "bigint", float: "double", list: "array<double>", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {ddl[type(values[n])]}" for n in names))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("0x000f3b2b4fb1ce3b", 0x000F3B2B4FB1CE3B), ("00:90:08:89:48:f2:18:a4", 0x0090088948F218A4), ("  2D038C21BB97557E ", 0x2D038C21BB97557E), ("01e9df4f0951576", 0x001E9DF4F0951576), ("ffffffffffffffff", None), ("0" * 16, None), ("n/a", None), ("", None), (None, None), ("fffffffffffffffe", -2), ("0123456789abcdef0", None)],
)
def test_hash64(spark, raw, want):
    assert one(spark, fields.hash64(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [("train", "train"), (" TRAIN ", "train"), ("train_set", "train"), ("trn", "train"), ("Validation", "validation"), ("val_set", "validation"), ("tst", "test"), ("testing", "test"), ("unassigned", None), ("", None), (None, None)])
def test_split_name(spark, raw, want):
    assert one(spark, fields.split_name(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [("Wetland-Clip:000000572 ", "wetland-clip:572"), ("wetland_clip:572", "wetland-clip:572"), ("wetland-clip%3A000000572", "wetland-clip:572"), ("wetland-clip : 000000572", "wetland-clip:572"), ("wetland-clip:0", "wetland-clip:0"), ("unknown", None), ("-", None), ("n/a", None), (None, None)])
def test_group_key(spark, raw, want):
    assert one(spark, fields.group_key(F.col("x")), x=raw) == want


def test_digest256(spark):
    d = "ab" * 32
    for raw, want in ((d.upper(), d), (f"sha256:{d}", d), ("0" * 64, None), (fields.EMPTY_SHA256, None), ("ab", None), (None, None)):
        assert one(spark, fields.digest256(F.col("x")), x=raw) == want


def test_licences_follow_from_family_modifiers_and_version(spark):
    families = {"cc by": True, "cc by sa": True, "cc by nd": False, "cc by nc nd": False, "cc sa": False, "gfdl": True, "pd": True, "mit": False, "public domain": True}
    for family, is_open in families.items():
        for version in ("", " 2", " 3.0"):
            for parted in (" ", "-", "_", "\t "):
                written = (family + version).replace(" ", parted)
                assert one(spark, text.open_licence(F.col("x")), x=written.upper()) is is_open, written
                assert not one(spark, text.open_licence(F.col("x")), x=written + parted + "except photographs")
    for value in (None, "", "  ", "4.0", "cc", "© cc0", "cc0 4.0.1"):
        assert not one(spark, text.open_licence(F.col("x")), x=value)


def test_name_normalizers_differ(spark):
    raw = "  Blue-Bird's  Näme 2 "
    assert one(spark, text.alnum_key(F.col("x")), x=raw) == "bluebirdsnäme2"
    assert one(spark, text.folded_key(F.col("x")), x=raw) == "bluebirdsname2"
    assert one(spark, text.ascii_key(F.col("x")), x=raw) == "bluebirdsnme2"
    assert one(spark, text.spaced_key(F.col("x")), x=raw) == "blue-bird's näme 2"
    assert one(spark, text.folded_key(F.col("x")), x="Straße") == "strasse"
    assert one(spark, text.capitalized(F.col("x")), x="ALPHA Bird") == "Alpha bird"
    assert one(spark, text.slug(F.col("x")), x="--A b/C--") == "a-b-c" and one(spark, text.slug(F.col("x")), x="!!") == "item"
    assert one(spark, F.array_join(text.aliases(F.col("x")), ","), x="a| b;c ||") == "a,b;c"
    assert one(spark, F.array_join(text.aliases(F.col("x"), True), ","), x="a| b;c ||") == "a,b,c"
    assert one(spark, text.english_words(F.col("x")), x="well-known birds, 3 of them") == 4


def test_safe_paths(spark):
    for path, safe in (("a/b.jpg", True), ("/a", False), ("a/../b", False), ("a//b", False), ("C:/x", False), ("a\\b", False), ("", False), ("./a", False)):
        assert one(spark, text.safe_relative_path(F.col("x")), x=path) is safe


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert spark.range(1).select(geometry.to_corners(box(2, 3, 4, 5))).first()[0] == [2, 3, 6, 8]
    assert spark.range(1).select(geometry.clip(box(-0.5, 2, 4, 7.5), F.lit(6), F.lit(6))).first()[0] == [0, 2, 4, 6]
    assert spark.range(1).select(geometry.clip(box(7, 0, 9, 2), F.lit(6), F.lit(6))).first()[0] is None
    c = spark.range(1).select(geometry.square_crop(box(0, 1, 4, 3), F.lit(10), F.lit(8)).alias("s")).select("s.*").first().asDict()
    assert (c["side"], c["left"], c["top"], c["right"], c["bottom"]) == (5, -1, -1, 4, 4)
    assert (c["pad_left"], c["pad_top"], c["pad_right"], c["pad_bottom"]) == (1, 1, 0, 0)
    assert not spark.range(1).select(geometry.valid_box(box(1, 1, 1, 2))).first()[0]


def test_vectors(spark):
    v = [3.0, 4.0]
    assert one(spark, vectors.norm(F.col("x")), x=v) == 5
    assert one(spark, vectors.l2_normalize(F.col("x")), x=v) == [0.6, 0.8]
    assert one(spark, vectors.cosine(F.col("x"), F.col("y")), x=v, y=[4.0, 3.0]) == pytest.approx(0.96)
    assert one(spark, vectors.combine(F.col("x"), F.col("y"), F.lit(0.0)), x=v, y=[9.0, 9.0]) == v
    assert one(spark, vectors.cross_entropy(F.col("x"), F.lit(1)), x=v) == pytest.approx(math.log(1 + math.exp(-1)))
    assert not one(spark, vectors.all_finite(F.col("x")), x=[1.0, float("nan")])


@pytest.mark.parametrize("a,b,p", [(4, 1, 0.375), (0, 0, 1.0), (257, 173, 5.959043353515875e-05), (150, 140, 0.5972)])
def test_mcnemar(spark, a, b, p):
    assert binomial_p(a, b) == pytest.approx(p, rel=1e-3)
    df = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    assert df.select(mcnemar_p(F.col("a"), F.col("b"))).first()[0] == pytest.approx(binomial_p(a, b), rel=1e-9)


def test_mcnemar_beyond_doubles(spark):
    df = spark.createDataFrame([(1547, 171), (1584, 218)], "a bigint, b bigint")
    got = [r[0] for r in df.select(exact_mcnemar_p("a", "b")).collect()]
    assert got == pytest.approx([2.9867e-277, 1.1043e-255], rel=1e-3)
