"""Held-out passages in a training corpus: a broadcast hash set of test n-grams against the documents' token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsus.runtime import materialize, ship

N = 12
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")


class GramIndex:
    """n-grams of the items' normalised words: gram -> the places (item, position) it has."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w.lower(), len(self.vocabulary)) for w in WORD.findall(text)]
            for at in range(len(codes) - n + 1):
                self.grams.setdefault(tuple(codes[at : at + n]), []).append((item, at))

    def spans(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, first word of the item, words, start, end): maximal common runs of at least n words, as character
        spans of the text. Only runs of words that some item holds are scanned; hits compare whole n-grams."""
        n, known = self.n, self.vocabulary
        places, codes = [], []
        for m in WORD.finditer(text):
            places.append(m)
            codes.append(known.get(m[0].lower(), -1))
        out: list[tuple[int, int, int, int, int]] = []
        open_runs: dict[tuple[int, int], int] = {}  # (item, diagonal) -> first document word
        at, total = 0, len(codes)
        last_unknown = -1
        for end in range(total):
            if codes[end] < 0:
                last_unknown = end
            at = end - n + 1
            hits = self.grams.get(tuple(codes[at : end + 1]), ()) if at > last_unknown else ()
            now = {(item, place - at): at for item, place in hits}
            for key in [k for k in open_runs if k not in now]:
                out.append(self._span(key, open_runs.pop(key), end, places))
            for key, first in now.items():
                open_runs.setdefault(key, first)
        for key, first in open_runs.items():
            out.append(self._span(key, first, total, places))
        return out

    @staticmethod
    def _span(key: tuple[int, int], first: int, stop: int, places: list) -> tuple[int, int, int, int, int]:
        return key[0], first + key[1], stop - first, places[first].start(), places[stop - 1].end()


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = N, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, item_word, words, start, end): every maximal passage of at least n words of an item in a document.

    Words are runs of letters and digits without case. The items go to the workers in blocks of at most block_words
    words, a fixed bound, and the documents are scanned whole once per block. Null and blank texts hold nothing, items
    of fewer than n words cannot leak, rows without an id are left out, repeated rows count once, other columns are
    ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    tests = items.select(F.col(item_id).cast("bigint").alias("_item"), F.col("text").alias("_test")).where("_item is not null and _test is not null").distinct()
    tests = materialize(tests.withColumn("_words", F.length("_test")))
    blocks = max(1, -(-(tests.agg(F.sum("_words")).first()[0] or 0) // (2 * block_words)))
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id).alias("_id"), F.col("text").alias("_text")).where("_id is not null and length(_text) >= 2")
    out = None
    for block in range(blocks):
        held = [(r[0], r[1]) for r in tests.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).select("_item", "_test").toLocalIterator()]
        shared = spark.sparkContext.broadcast(GramIndex(held, n))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                rows = [(i, *s) for i, t in zip(batch["_id"], batch["_text"]) for s in index.spans(t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_word", "words", "start", "end"])

        part = source.mapInPandas(run, f"doc_id {kind}, item_id bigint, item_word int, words int, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leaks(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, item_id): the documents that hold n consecutive words of an item, with each such item."""
    return leaked_spans(documents, items, n).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """Per item: documents it leaked into and its longest leaked passage in words; 0 for items that leaked nowhere."""
    found = leaked_spans(documents, items, n).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "suite").distinct().join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


def cleaned(documents: DataFrame, items: DataFrame, n: int = N, drop_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed): affected documents without the leaked spans; text is null where the spans cover more
    than drop_share of the document, which is then to be dropped."""
    spans = leaked_spans(documents, items, n).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, spans in zip(batch["doc_id"], batch["_text"], batch["_spans"]):
                kept, at, gone = [], 0, 0
                for s in spans:
                    lo, hi = max(at, s["start"]), s["end"]
                    if hi > lo:
                        kept.append(text[at:lo])
                        gone, at = gone + hi - lo, hi
                kept.append(text[at:])
                rows.append((i, None if gone > drop_share * len(text) else "".join(kept), gone))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.select("doc_id", F.col("text").alias("_text")).where("doc_id is not null and _text is not null")
    return texts.join(spans, "doc_id").mapInPandas(cut, f"doc_id {kind}, text string, removed int")
