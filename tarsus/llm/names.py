"""Freely typed names mapped to a canonical list: BK-trees under the Levenshtein metric, by shards whose winners merge.

A typed value is reduced to its letters, of any script (accents, case, separators, numbers and leading doubts removed),
and to readings of them, as remarks, authors and subspecies follow a name: every run of its first words that is no longer
than an entry may be. Names are compared
without blanks, so a lost blank costs nothing. A BK-tree holds the entries of a shard; a search returns every entry
within the threshold, and skips a subtree whose edge differs from the node's distance by more than the threshold, which
the triangle inequality allows. Distances of whole frontiers are computed at once, bit-parallel over 64-bit words; entries
of more than 64 letters, or with letters beyond the shard's most frequent ones, take the same distance cell by cell.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsus.functions.fields import taxon_key
from tarsus.runtime import materialize, ship

MAX_EDITS = 4
SHARD_ENTRIES = 20_000
#: Letters that have no decomposition, and words of doubt that stand before a name.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
BEFORE = frozenset("prob probably poss possibly cf aff bird birds maybe perhaps ca near nr".split())
AFTER = frozenset("sp spp spec species genus".split())
WORD = re.compile(r"[^\W\d_]+")
WORD_BITS = 64
ALPHABET = 62  # letters of a shard that have bit masks of their own


def words_of(text: str) -> tuple[list[str], list[str]]:
    """The name's words, letters without accents in lower case, and the words that a comma puts after the first part.

    Words of doubt before the name are left out; brackets that hold a number (authors, counters) end it.
    """
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold().translate(LETTERS)
    plain = re.sub(r"\([^)]*\)|\[[^\]]*\]", lambda m: " , " if re.search(r"\d", m[0]) else " " + m[0][1:-1] + " ", plain)
    parts = [p for p in map(WORD.findall, plain.split(",")) if p]
    if not parts:
        return [], []
    head = parts[0]
    while len(head) > 1 and head[0] in BEFORE:
        head = head[1:]
    return head, parts[1] if len(parts) > 1 else []


def _runs(words: list[str], longest: int) -> list[str]:
    """The first words joined, for any number of them up to a length."""
    out, now = [], ""
    for w in words:
        now += w
        out.append(now)
        if len(now) >= longest:
            break
    return out


def readings(text: str, longest: int = 1 << 30) -> list[str]:
    """What may be compared with entries: the first words joined, for any number of them; "g epithet" if abbreviated;
    "lark, northern" also turned round. Runs that go on beyond `longest` letters, more than any entry can be near to,
    are not built."""
    words, rest = words_of(text)
    if not words or (len(words) > 1 and words[1] in AFTER):
        return []
    if len(words[0]) == 1:
        return [f"{words[0]} {words[1]}"] if len(words) > 1 and len(words[1]) > 3 else []
    joined = _runs(words, longest)
    if len(words) == 1:
        joined += [r + words[0] for r in _runs(rest, longest)]
    return [j for j in dict.fromkeys(joined) if len(j) >= 4]


def entry_keys(name: str, scientific: bool) -> list[str]:
    """The strings an entry is found by."""
    words, rest = words_of(name)
    if not words:
        return []
    if len(words) == 1 and rest:
        words = rest + words
    keys = ["".join(words)]
    if scientific and len(words) == 2 and len(words[0]) > 1:
        keys.append(f"{words[0][0]} {words[1]}")
    return keys


def allowed(length: int, most: int = MAX_EDITS) -> int:
    """Edits that a name of this length may have and still be told from others."""
    return min(most, length // 4)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a row of cells at a time."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at, codes = np.arange(len(b) + 1), np.array([ord(c) for c in b])
    row = at.copy()
    for i, c in enumerate(a, 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(step - at) + at  # insertions
    return int(row[-1])


class BKTree:
    """Entries of any length; `children` of a node by their distance to it."""

    def __init__(self, strings: list[str]):
        strings = list(dict.fromkeys(strings))
        self.strings = strings
        self.length = np.array([len(s) for s in strings], np.int64)
        common = Counter(c for s in strings for c in s).most_common(ALPHABET)
        self.code = {c: i for i, (c, _) in enumerate(common, 1)}  # 0 is any other letter, which equals none of an entry's
        self.slow = np.array([len(s) > WORD_BITS or any(c not in self.code for c in s) for s in strings], bool)
        self.peq = np.zeros((len(strings), ALPHABET + 2), np.uint64)
        for i, s in enumerate(strings):
            if not self.slow[i]:
                for j, c in enumerate(s):
                    self.peq[i, self.code[c]] |= np.uint64(1 << j)
        self.exact = {s: i for i, s in enumerate(strings)}
        self.edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # node -> distances, child nodes
        todo = [np.arange(len(strings))] if strings else []
        while todo:
            members = todo.pop()
            root, rest = int(members[0]), members[1:]
            if not len(rest):
                continue
            d = self.distances([self.strings[root]], np.zeros(len(rest), np.int64), rest)
            at = np.unique(d)
            groups = [rest[d == x] for x in at]
            self.edges[root] = (at, np.array([g[0] for g in groups], np.int64))
            todo += groups

    def distances(self, queries: list[str], q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Levenshtein distances of the pairs (queries[q[i]], strings[nodes[i]])."""
        out = np.empty(len(q), np.int64)
        slow = self.slow[nodes]
        for i in np.nonzero(slow)[0]:
            out[i] = edit_distance(queries[q[i]], self.strings[nodes[i]])
        fast = np.nonzero(~slow)[0]
        width = max(map(len, queries), default=0)
        text = np.zeros((len(queries), width), np.int64)
        size = np.array([len(s) for s in queries], np.int64)
        for i, s in enumerate(queries):
            text[i, : len(s)] = [self.code.get(c, 0) for c in s]
        got = np.empty(len(fast), np.int64)
        for lo in range(0, len(fast), 1 << 16):
            some = fast[lo : lo + (1 << 16)]
            self._block(text, size, q[some], nodes[some], got[lo : lo + (1 << 16)])
        out[fast] = got
        return out

    def _block(self, text: np.ndarray, size: np.ndarray, q: np.ndarray, nodes: np.ndarray, out: np.ndarray) -> None:
        order = np.argsort(-size[q], kind="stable")
        q, nodes = q[order], nodes[order]
        n, m, peq = size[q], self.length[nodes], self.peq[nodes]
        one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
        pv, mv, score = np.full(len(q), full), np.zeros(len(q), np.uint64), m.copy()
        top = (m - 1).astype(np.uint64)
        for j in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -j, side="left"))  # pairs whose query has a j-th character come first
            e = peq[np.arange(live), text[q[:live], j]]
            p, v = pv[:live], mv[:live]
            xv = e | v
            xh = (((e & p) + p) ^ p) | e
            ph, mh = v | ~(xh | p), p & xh
            score[:live] += ((ph >> top[:live]) & one).astype(np.int64) - ((mh >> top[:live]) & one).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            pv[:live], mv[:live] = mh | ~(xv | ph), ph & xv
        out[order] = score

    def search(self, queries: list[str], limits: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query every (distance, node) within its limit."""
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not self.strings or not queries:
            return found
        q, nodes = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(q):
            d = self.distances(queries, q, nodes)
            for i in np.nonzero(d <= limits[q])[0]:
                found[q[i]].append((int(d[i]), int(nodes[i])))
            next_q, next_nodes = [], []
            order = np.argsort(nodes, kind="stable")
            cuts = np.nonzero(np.diff(nodes[order]))[0] + 1
            for part in np.split(order, cuts):
                edge = self.edges.get(int(nodes[part[0]]))
                if edge is None:
                    continue
                near = np.abs(d[part][:, None] - edge[0][None, :]) <= limits[q[part]][:, None]
                r, c = np.nonzero(near)
                next_q.append(q[part][r])
                next_nodes.append(edge[1][c])
            q = np.concatenate(next_q) if next_q else np.array([], np.int64)
            nodes = np.concatenate(next_nodes) if next_nodes else np.array([], np.int64)
        return found


def reference_names(taxa: DataFrame, overrides: DataFrame, wetland: DataFrame) -> DataFrame:
    """(name, scientific, taxon_id): both names of the taxa, and the source names of rows that have a birdnet id."""

    def of(df: DataFrame, name: str, scientific: bool, taxon) -> DataFrame:
        return df.select(F.col(name).alias("name"), F.lit(scientific).alias("scientific"), taxon.alias("taxon_id"))

    linked = F.concat(F.lit("birdnet:"), taxon_key(F.col("birdnet_id")))
    parts = [of(taxa, "scientific_name", True, F.col("taxon_id")), of(taxa, "common_name", False, F.col("taxon_id"))]
    for df in (overrides, wetland):
        parts += [of(df, "source_scientific_name", True, linked), of(df, "source_common_name", False, linked)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("name is not null and taxon_id is not null").distinct()


def best_matches(typed: DataFrame, reference: DataFrame, col: str = "text", max_edits: int = MAX_EDITS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(text, distance, taxa): for each distinct typed text the entries at the smallest distance within the threshold.

    Of entries that a text holds exactly, the longest counts. `taxa` is the set of ids at that distance; more than one
    mean that the text is ambiguous. Texts without a match, null and blank ones give no row. The reference comes to the
    driver shard by shard, each of a bounded number of entries; the tree of a shard is broadcast, and the winners of all
    shards merge by their distance and length, so that the number of shards changes nothing.
    """
    spark = typed.sparkSession
    ship(spark)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, taxon) for name, scientific, taxon in zip(b["name"], b["scientific"], b["taxon_id"]) for key in entry_keys(name, scientific)]
            yield pd.DataFrame(rows, columns=["key", "taxon_id"])

    entries = materialize(reference.mapInPandas(keyed, "key string, taxon_id string").distinct())
    keys, longest = entries.agg(F.count_distinct("key"), F.max(F.length("key"))).first()
    shards, longest = max(1, -(-keys // shard_entries)), (longest or 0) + max_edits
    texts = materialize(typed.select(F.col(col).cast("string").alias("text")).where(F.col("text").rlike(r"\p{L}")).distinct())
    winners = None
    for shard in range(shards):
        ids: dict[str, set[str]] = {}
        for key, taxon in entries.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard).toLocalIterator():
            ids.setdefault(key, set()).add(taxon)
        held = sorted(ids)
        shared = spark.sparkContext.broadcast((BKTree(held), [sorted(ids[k]) for k in held]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tree, taxa = shared.value
            for batch in batches:
                asked, of = [], []
                best: dict[int, tuple[int, int, set[str]]] = {}
                for i, text in enumerate(batch["text"]):
                    said = readings(text, longest)
                    hits = [tree.exact[r] for r in said if r in tree.exact]
                    if hits:  # the longest reading that is an entry
                        best[i] = (0, len(tree.strings[hits[-1]]), set(taxa[hits[-1]]))
                        continue
                    for r in said:
                        if len(r) <= longest and allowed(len(r), max_edits):
                            asked.append(r)
                            of.append(i)
                distinct = list(dict.fromkeys(asked))
                place = {r: n for n, r in enumerate(distinct)}
                found = tree.search(distinct, np.array([min(2, max_edits) if " " in r else allowed(len(r), max_edits) for r in distinct], np.int64))
                for r, i in zip(asked, of):
                    for d, node in found[place[r]]:
                        if (" " in r) != (" " in tree.strings[node]):
                            continue
                        if i not in best or d < best[i][0]:
                            best[i] = (d, 0, set(taxa[node]))
                        elif d == best[i][0]:
                            best[i][2].update(taxa[node])
                rows = [(batch["text"].iloc[i], d, size, sorted(t)) for i, (d, size, t) in best.items()]
                yield pd.DataFrame(rows, columns=["text", "distance", "size", "taxa"])

        part = texts.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(run, "text string, distance int, size int, taxa array<string>")
        winners = part if winners is None else winners.unionByName(part)
    if shards == 1:
        return winners.drop("size")
    winners = materialize(winners)
    first = winners.groupBy("text").agg(F.min(F.struct("distance", (-F.col("size")).alias("size"))).alias("_w")).select("text", "_w.distance", (-F.col("_w.size")).alias("size"))
    return winners.join(first, ["text", "distance", "size"]).groupBy("text", "distance").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("taxa")))).alias("taxa"))  # one list a shard


def resolve(cases: DataFrame, reference: DataFrame) -> DataFrame:
    """(entry_kind, entry_id, text, taxon_id, distance) for cases (entry_kind, entry_id, text).

    taxon_id is that of the one taxon at the smallest distance, or `none`: for null and blank texts, for names of a
    genus only, for names too far from every entry, and for names as near to several taxa. A case that arrives twice
    counts once.
    """
    cases = cases.where("entry_id is not null").distinct()
    matched = materialize(best_matches(cases, reference))
    one = F.when(F.size("taxa") == 1, F.get("taxa", F.lit(0)))
    out = cases.join(matched, "text", "left")
    return out.select("entry_kind", "entry_id", "text", F.coalesce(one, F.lit("none")).alias("taxon_id"), "distance")


def open_cases(samples: DataFrame, overrides: DataFrame, wetland: DataFrame) -> DataFrame:
    """(entry_kind, entry_id, text): records without taxon, and override and wetland rows without birdnet id."""
    s = samples.where(taxon_key(F.col("taxon_id")).isNull()).select(F.lit("sample").alias("entry_kind"), F.col("record_id").alias("entry_id"), F.col("raw_label").alias("text"))
    o = overrides.where(taxon_key(F.col("birdnet_id")).isNull()).select(F.lit("override").alias("entry_kind"), F.col("override_id").alias("entry_id"), F.col("source_scientific_name").alias("text"))
    w = wetland.where(taxon_key(F.col("birdnet_id")).isNull()).select(F.lit("wetland").alias("entry_kind"), F.col("source_species_id").alias("entry_id"), F.col("source_common_name").alias("text"))
    return s.unionByName(o).unionByName(w)


def unmatched(resolved: DataFrame) -> DataFrame:
    """(entry_kind, text, entries): the values that name no entry, with how often each was typed."""
    return resolved.where("taxon_id = 'none'").groupBy("entry_kind", "text").agg(F.count(F.lit(1)).alias("entries"))
