"""Canonical values of the manifest fields that arrive in several spellings. All are JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_BLANK = r"^[\s ﻿]+|[\s ﻿]+$"


def squeeze(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(c, _BLANK, ""))


def split_name(c: Column) -> Column:
    """train, validation or test, whatever the spelling; null for any other value."""
    s = F.regexp_replace(squeeze(c), r"[\s_.-]*(set|split|data)?$", "")
    return (
        F.when(s.isin("train", "training", "trn", "tr"), "train")
        .when(s.isin("validation", "validate", "valid", "val", "vld", "dev"), "validation")
        .when(s.isin("test", "testing", "tst", "te"), "test")
    )


def hash64(c: Column) -> Column:
    """A 64-bit perceptual hash as bigint. Null where missing, unreadable, or all 64 bits are equal.

    Readable: 1 to 16 hexadecimal digits (lost leading zeros count as zeros), in either case, with 0x before them or
    colons, blanks or hyphens between pairs.
    """
    s = F.regexp_replace(F.regexp_replace(squeeze(c), r"^0x", ""), r"(?<=[0-9a-f]{2})[:\s-](?=[0-9a-f])", "")
    v = F.when(s.rlike(r"^[0-9a-f]{1,16}$"), F.conv(s, 16, -10).cast("bigint"))
    return F.when(~v.isin(0, -1), v)


def digest256(c: Column) -> Column:
    """A SHA-256 in lower case; null where missing, malformed, one repeated digit, or the digest of an empty file."""
    s = F.regexp_replace(squeeze(c), r"^sha-?256[:=\s]*|^0x", "")
    return F.when(s.rlike(r"^[0-9a-f]{64}$") & ~s.rlike(r"^([0-9a-f])\1{63}$") & (s != EMPTY_SHA256), s)


def group_key(c: Column) -> Column:
    """kind:number of a group id; null where missing or a placeholder. Case, separators and leading zeros don't count."""
    s = F.regexp_replace(F.regexp_replace(squeeze(c), "%3a", ":"), r"[\s_-]+", "-")
    kind = F.regexp_replace(F.regexp_extract(s, r"^([a-z][a-z0-9-]*?)-?:-?(\d+)$", 1), "-+", "-")
    number = F.regexp_extract(s, r"^([a-z][a-z0-9-]*?)-?:-?0*(\d+)$", 2)
    return F.when(number != "", F.concat(kind, F.lit(":"), number))


def taxon_key(c: Column) -> Column:
    """A taxon id without blanks at the ends; null where missing or a placeholder."""
    s = F.regexp_replace(c, _BLANK, "")
    return F.when(~F.lower(s).isin("", "-", "n/a", "na", "none", "null", "unknown", "?"), s)
