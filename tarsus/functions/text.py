"""Name normalizers and text predicates. The normalizers differ on purpose and must not be merged (STR1-STR12)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_EDGES = r"^\s+|\s+$"


def alnum_key(c: Column) -> Column:
    """STR1: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


@pandas_udf(T.StringType())
def folded_key(s: pd.Series) -> pd.Series:
    """STR2: compatibility decomposition without marks, case folded, letters and digits only; no built-in decomposes."""

    def fold(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if c.isalnum() and not unicodedata.combining(c))

    return s.map(fold, na_action="ignore")


def ascii_key(c: Column) -> Column:
    """STR3: lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def spaced_key(c: Column) -> Column:
    """STR4: lower case, runs of white space as one blank."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, _EDGES, ""), r"\s+", " "))


def aliases(c: Column, semicolons: bool = False) -> Column:
    """STR5: non-blank aliases between | (and ; if asked)."""
    return F.filter(F.transform(F.split(c, "[|;]" if semicolons else r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def slug(c: Column, otherwise: str = "item") -> Column:
    """STR6: lower-case words joined by hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", otherwise).otherwise(s)


def safe_relative_path(c: Column) -> Column:
    """STR7: a relative POSIX path without empty, . or .. parts, backslashes or drive letters."""
    parts = F.split(c, "/")
    return (F.length(c) > 0) & ~c.contains("\\") & ~c.rlike("^([A-Za-z]:|/)") & F.forall(parts, lambda p: (p != "") & (p != ".") & (p != ".."))


def is_hex(c: Column, digits: int) -> Column:
    """STR8: exactly so many lower-case hexadecimal digits."""
    return c.rlike(f"^[0-9a-f]{{{digits}}}$")


def is_identifier(c: Column) -> Column:
    """STR8: letters, digits, dot, underscore and hyphen, starting with a letter or digit."""
    return c.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$")


def binomial(c: Column) -> Column:
    """STR9: Genus species."""
    s = F.lower(F.trim(c))
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def frame_id(c: Column) -> Column:
    """STR10: the digits before the last underscore part of a file name."""
    return F.regexp_extract(c, r"(\d+)_[^_/]*$", 1)


def english_words(c: Column) -> Column:
    """STR11: English words, hyphenated ones as one."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z]+(?:-[A-Za-z]+)*"), 0))


def numbered_name(prefix: str, n: Column, width: int = 6) -> Column:
    """STR12, PRJ6: a prefix and a number of fixed width."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def capitalized(c: Column) -> Column:
    """PRJ3: the first letter in upper, all others in lower case."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


#: The licences that allow training, as their words without a version.
OPEN_LICENCES = ("cc0", "pd", "public domain", "gfdl", "cc by", "cc by nc", "cc by sa", "cc by nc sa")


def open_licence(c: Column) -> Column:
    """FIL3: whether a licence is one of OPEN_LICENCES in any version; anything more in it, a sign or a clause, closes it.

    Words are parted by blanks, hyphens or underscores. Null and blank are not open.
    """
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(c), _EDGES, ""), r"\s+", " "), "[ _-]")
    numbered = F.element_at(words, -1).rlike(r"^\d+(\.\d+)?$")
    named = F.when(numbered, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return F.coalesce(F.array_join(named, " ").isin(*OPEN_LICENCES), F.lit(False))
