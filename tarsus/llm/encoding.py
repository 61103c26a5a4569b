"""Text that was decoded with the wrong character encoding: detection, round-trip repair, and what cannot be restored.

Repair re-encodes suspicious runs under a candidate legacy encoding and decodes them strictly as the intended one. It is
repeated for nested layers, until no layer is left that lowers the garbling cost of the text. Three families of damage
are tried: UTF-8 bytes read as a one-byte encoding, one one-byte encoding read as another, and runs of another script's
legacy encoding read as a western one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsus.runtime import ship

LEGACY = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15", "iso8859_2", "cp1254", "koi8_r")
#: (intended, read as): one-byte encodings that were taken for another one.
CONFUSED = tuple((i, r) for i in ("mac_roman", "cp437", "cp850", "cp1252") for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251") if i != r)
#: Legacy encodings of other scripts, and what their bytes are mostly read as.
SCRIPTS = ("shift_jis", "euc_jp", "euc_kr", "gb2312", "big5", "cp1251", "koi8_r", "cp1253", "cp1255", "cp1256", "cp874")
READ_AS = ("cp1252", "latin-1")
LOSS = "�"

#: Letters that clean en, fr, de and es texts and names don't use, and those that may stand alone.
RARE = "ÒÌÐÝÞŠŽŸƒðýþšžÿìòıŁ"
ALONE = "àÀáÁéÉèÈóÓùÙôÔíÍúÚöÖäÄüÜåÅøØêÊæÆ"
DASHES, OPENING, CLOSING, APOSTROPHES = "–—―", "“„«‚‘‹¿¡", "”»’›…“‘", "’‘´"
#: Words before a lone garbled sign that say that it is spoken about.
CUES = r"(?:see|sees|saw|seen|show|shows|showed|shown|mark|marks|character|characters|char|sign|signs|symbol|symbols|glyph|sequence|sequences|string|letters?|byte|bytes|as|like|Zeichen|Folge|signe|caractère|carácter|signo|contains?)"


@cache
def byte_table(encoding: str) -> dict[str, int]:
    """Character -> byte of the upper half; bytes that the encoding leaves open stand for control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@cache
def sequence_pattern(encoding: str) -> re.Pattern:
    """Runs of characters whose bytes under the encoding have the form of UTF-8 sequences."""
    table = byte_table(encoding)
    of = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"
    tail = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{tail}|{of(0xF0, 0xF4)}{tail}{tail}{tail})+")


@cache
def suspects() -> re.Pattern:
    """A cheap first look: a lead and a tail of any candidate encoding side by side."""
    leads, tails = set(), set()
    for e in LEGACY:
        for c, b in byte_table(e).items():
            (tails if b < 0xC0 else leads).add(c)
    of = lambda s: "[" + "".join(map(re.escape, sorted(s))) + "]"
    return re.compile(of(leads) + of(tails))


def fits(text: str, i: int) -> bool:
    """Whether the non-ASCII character at i stands where such a character stands in clean text."""
    c = text[i]
    before = text[i - 1] if i else " "
    after = text[i + 1] if i + 1 < len(text) else " "
    if c == LOSS or "\x80" <= c <= "\x9f":
        return False
    if c in "\xa0\xad ​﻿":
        return True
    if c in DASHES:
        return (before.isspace() and after.isspace()) or (before.isalnum() and after.isalnum() and not before.isalpha())
    if c in APOSTROPHES and before.isalpha() and after.isalpha():
        return True
    if c in OPENING and not before.isalnum() and (after.isalnum() or after in "\xa0  "):
        return c not in "¿¡" or after.isupper()
    if c in CLOSING and not after.isalnum() and (before.isalnum() or before in ".,!?;:)%…\xa0  "):
        return True
    if c in "°º":
        return before.isdigit() or before.isspace() or after == "C"
    if c in "€£§©®™µ×±½¼¾²³·•†‡":
        return not before.isalpha() and not after.isalpha()
    if "\u0300" <= c and unicodedata.category(c) in ("Mn", "Mc"):
        return before.isalpha() or unicodedata.category(before) in ("Mn", "Mc")
    if "\u3000" <= c < "\u3040" or "\uff00" <= c < "\uff66":  # signs between ideographs
        return True
    if unicodedata.category(c) not in ("Lu", "Ll", "Lo") or c in RARE:
        return False
    if c >= "\u0590" and not c.isupper() and not c.islower():  # a script without case stands among digits and words of its own
        return True
    if before.isdigit() or after.isdigit():
        return False
    if not before.isalnum() and not after.isalnum():
        return c in ALONE
    if c.isupper():
        return not before.islower()
    return not before.isupper() or after.isupper() or not after.isalpha() or i < 2 or not text[i - 2].isalpha()


def script(c: str) -> str:
    o = ord(c)
    return "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "latin" if c.isalpha() and (o < 0x250 or 0x1E00 <= o < 0x1F00) else "other"


OTHER_SCRIPTS = re.compile(r"[^\W\d_\x00-\u024f]")
LETTERS = re.compile(r"[^\W\d_]+")
STRANGE = re.compile(r"[^\x00-\x7f]")
STRANGE_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
CAPITALS = re.compile(r"(?<![^\W\d_])[^\W\d_a-zß-öø-ÿ]{2}[^\W\d_]+")


def cost(text: str) -> int:
    """Garbling cost: characters out of place, lost or control characters, and words of mixed scripts or of capitals that
    end in small letters."""
    total = sum(not fits(text, m.start()) for m in STRANGE.finditer(text))
    if OTHER_SCRIPTS.search(text):
        for word in LETTERS.findall(text):
            total += not word.isascii() and len({script(c) for c in word}) > 1
    for m in CAPITALS.finditer(text):
        total += not m[0].isascii() and m[0][:2].isupper() and not m[0].isupper()
    return total


def _plausible(decoded: str, encoding: str) -> bool:
    """Whether a decoded run may be what was meant: western letters and signs, or two letters at least of other scripts."""
    other = 0
    for c in decoded:
        o = ord(c)
        if "\x80" <= c <= "\x9f" or c == LOSS:
            return False
        if 0xA0 <= o < 0x180 or 0x2010 <= o <= 0x203A or c in "€™ŠšŽžœŒŸƒˆ˜−≈≤≥" or 0x1E00 <= o < 0x1F00:
            continue
        if 0x370 <= o < 0x530:
            other += 1
        elif unicodedata.category(c) in ("Lo", "Mn", "Mc") and o >= 0x590:
            other += 1
        elif not (0x1F000 <= o < 0x1FB00 or 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF66):
            return False
    return other != 1


def mention(text: str, start: int, end: int, repaired: str) -> bool:
    """Whether the run at start:end is shown on purpose: it stands alone, and in quotation marks, or after a word that
    announces a sign, or as an apostrophe between blanks."""
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    if before.isalnum() or after.isalnum():
        return False
    if before in "“„«\"'‘`‚([" and after in "”“»\"'’`)]":
        return True
    if re.search(rf"\b{CUES}\s+$", text[max(0, start - 24) : start], re.IGNORECASE):
        return True
    if repaired == LOSS:
        return after in ",;:.)"
    return before.isspace() and (after.isspace() or after in ",;.") and set(repaired) <= set("’‘´`'")


def repair_layer(text: str, encoding: str) -> tuple[str, int]:
    """The text with the encoding's UTF-8 sequences decoded, and how many runs were; mentions stay."""
    table = byte_table(encoding)
    out, last, n = [], 0, 0
    for m in sequence_pattern(encoding).finditer(text):
        try:
            good = bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not _plausible(good, encoding) and not sequence_or_nested(good):
            continue
        if mention(text, m.start(), m.end(), good):
            continue
        out += [text[last : m.start()], good]
        last, n = m.end(), n + 1
    return "".join([*out, text[last:]]), n


def sequence_or_nested(decoded: str) -> bool:
    """Whether a decoded run is itself UTF-8 read wrongly, one layer further down."""
    return any((m := sequence_pattern(e).search(decoded)) is not None and m[0] == decoded for e in ("cp1252", "latin-1"))


@cache
def _confusion(intended: str, read: str) -> dict[int, str]:
    out = {}
    for c, b in byte_table(read).items():
        try:
            good = bytes([b]).decode(intended)
        except UnicodeDecodeError:
            continue
        if good != c and good.isprintable():
            out[ord(c)] = good
    return out


FOREIGN = re.compile(r"[^\x00-\x7f]{2}[^\n]*[^\x00-\x7f]{2}")
WORD = re.compile(r"\S+")
SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|$)")


def repair_confusion(text: str) -> tuple[str, bool]:
    """One one-byte encoding read as another: the pair that lowers the cost of the text's sentences most is applied to
    those sentences whose cost it lowers without leaving a changed character out of place; then the same by word, for
    passages that end within a sentence."""
    now, sentences = _confused_parts(text, SENTENCE)
    now, words = _confused_parts(now, WORD)
    return now, sentences or words


def _confused_parts(text: str, part: re.Pattern) -> tuple[str, bool]:
    if any(_shown(m[0]) for m in SENTENCE.finditer(text)) and part is WORD:
        return text, False
    spots = [m for m in part.finditer(text) if not m[0].isascii()]
    old = [cost(m[0]) for m in spots]
    if not any(old):
        return text, False
    best, gain = None, 0
    for intended, read in CONFUSED:
        table = _confusion(intended, read)
        new = [m[0].translate(table) if c else m[0] for m, c in zip(spots, old)]
        costs = [cost(n) if c else 0 for n, c in zip(new, old)]
        total = sum(max(0, c - k) for c, k, n, m in zip(old, costs, new, spots) if not _shown(m[0]) and all(fits(n, i) for i in _changed(m[0], n)))
        if total > gain:
            best, gain = table, total
    if best is None:
        return text, False
    out, last = [], 0
    for m, c in zip(spots, old):
        n = m[0].translate(best)
        if c and cost(n) < c and not _shown(m[0]) and all(fits(n, i) for i in _changed(m[0], n)):
            out += [text[last : m.start()], n]
            last = m.end()
    return "".join([*out, text[last:]]), True


def _block_of(c: str) -> str:
    return script(c) if ord(c) < 0x590 else "cjk" if ord(c) >= 0x2E80 else str(ord(c) >> 7)


def repair_script(text: str) -> tuple[str, bool]:
    """Stretches of a line whose bytes are those of another script's legacy encoding: the encoding that decodes them
    strictly, to letters of one script other than latin, at the least cost and at less than half of the cost before."""
    out, last = [], 0
    for m in FOREIGN.finditer(text):
        old, best = cost(m[0]), None
        strangers = sum(c > "\x7f" for c in m[0])
        if old < 4 or strangers < 6 or 2 * strangers < len(m[0].replace(" ", "")) or _shown(m[0]):
            continue
        for read in READ_AS:
            table = byte_table(read)
            try:
                raw = bytes(table[c] if c > "\x7f" else ord(c) for c in m[0])
            except KeyError:
                continue
            for intended in SCRIPTS:
                try:
                    new = raw.decode(intended)
                except UnicodeDecodeError:
                    continue
                letters = [c for c in new if c > "\x7f" and c.isalpha()]
                if 2 * len(letters) < len(new.replace(" ", "")) or len({_block_of(c) for c in letters}) > 1 or _block_of(letters[0]) == "latin":
                    continue
                strange = sum(c > "\x7f" and not c.isalpha() and not fits(new, i) for i, c in enumerate(new)) + sum(len({c.isupper() for c in w[1:]}) > 1 or w[:1].islower() and w[1:].isupper() for w in LETTERS.findall(new))
                own = sum("\u3040" <= c < "\u3100" or c >= "\uac00" for c in letters)  # kana and hangul tell encodings of ideographs apart
                if 2 * (cost(new) + strange) < old and (best is None or (cost(new) + strange, -own) < best[:2]):
                    best = cost(new) + strange, -own, new
        if best:
            out += [text[last : m.start()], best[2]]
            last = m.end()
    return "".join([*out, text[last:]]), bool(out)


def _changed(old: str, new: str) -> list[int]:
    return [i for i, (a, b) in enumerate(zip(old, new)) if a != b] if len(old) == len(new) else []


def _shown(sentence: str) -> bool:
    """Whether the sentence speaks about garbled characters: a run of them stands as a mention."""
    return any(not m[0].isascii() and mention(sentence, m.start(), m.end(), _first_reading(m[0])) for m in re.finditer(r"[^\x00-\x7f“”„«»]+", sentence))


def _first_reading(run: str) -> str:
    for e in ("cp1252", "latin-1"):
        new, n = "", 0
        for m in sequence_pattern(e).finditer(run):
            try:
                new, n = new + bytes(byte_table(e)[c] for c in m[0]).decode("utf-8"), n + 1
            except UnicodeDecodeError:
                return run
        if n:
            return new
    return run


def lost(text: str) -> bool:
    """Whether replacement characters stand for characters that cannot be restored."""
    return any(not mention(text, m.start(), m.end(), LOSS) for m in re.finditer(LOSS + "+", text))


#: A lead of the commonest damage whose no-break space became a blank: "Ã " for "à".
BLANKED = re.compile(r"(?<![A-ZÀ-Þ])Ã (?![A-ZÀ-Þ])")


def settled(text: str, now: int, seen: dict[str, tuple[str, int]]) -> tuple[str, int]:
    """The text at the least cost that layers of UTF-8 repair lead to, each of which lowers the cost, and that cost."""
    if text not in seen:
        best = text, now
        runs = " ".join(STRANGE_RUNS.findall(text)) if now else ""  # where a sequence may lie
        if suspects().search(runs):
            for e in LEGACY:
                if not sequence_pattern(e).search(runs):
                    continue
                new, n = repair_layer(text, e)
                if n and new not in seen and (c := cost(new)) < now:
                    best = min(best, settled(new, c, seen), key=lambda x: x[1])
        seen[text] = best
    return seen[text]


def repair(text: str) -> tuple[str, bool, bool]:
    """(best text, whether any passage was garbled, whether the original was restored in full)."""
    if text.isascii():
        return text, False, True
    before = cost(text)
    now, left = settled(text, before, {})
    garbled = now != text
    if garbled:
        now = BLANKED.sub(lambda m: "à" if now[m.end() : m.end() + 1] in tuple(" \xa0\n.,;:!?)") else "à ", now)
    if cost(now) if garbled else left:
        now, foreign = repair_script(now)
        now, confused = repair_confusion(now) if not foreign else (now, False)
        garbled |= foreign or confused
    gone = LOSS in now and lost(now)
    return now, garbled or gone, not gone and (not garbled or cost(now) == 0)


def repaired_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored_text, complete): the documents of which a passage was decoded wrongly, with the best text.

    `complete` is false where characters were lost for good, or where some still stand out of place. Null, blank and pure ASCII texts are never affected and
    are set aside before Python sees them; texts are read whole. Other columns are ignored, rows without an id left out.
    """
    ship(documents.sparkSession)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch["_id"], batch["_text"]) for r in (repair(t),) if r[1]]
            if rows:
                yield pd.DataFrame([(i, t, c) for i, t, _, c in rows], columns=["doc_id", "restored_text", "complete"])

    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").rlike(r"[^\x00-\x7f]"))
    return source.mapInPandas(run, f"doc_id {id_type}, restored_text string, complete boolean").distinct()
