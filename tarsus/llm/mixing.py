"""A training mix of sources at target shares: pivotal dependent rounding of fractional copy numbers.

Every document of a source gets the same expected number of copies, target tokens / tokens of the source. The whole
part is certain; the fraction is rounded by pivoting: two documents with open fractions pass mass to each other, in
tokens, in a random direction that keeps both expectations, until one of them is at 0 or 1. Tokens are kept at every
step, so a source misses its target by the tokens of one document at most. Blocks of documents pivot on their own and
leave one open fraction each; a reduction tree combines these until one is left per source, which a draw decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarsus.runtime import materialize, ship

#: Default of the setting spark.tarsus.tokenizer: a public vocabulary, as ranks (.tiktoken) or a tokenizers file (.json).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies of 50k ranks cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_ROWS = 20_000
FAN_IN = 64
OPEN = "doc_id {kind}, source string, tokens bigint, whole int, part double, block bigint"


_counters: dict[int, Callable[[list[str]], list[int]]] = {}


def counter(content: str, ranks: bool) -> Callable[[list[str]], list[int]]:
    """The token counts of whole texts under a tokenizer file's content, built once a worker. Special tokens' names in a
    text are ordinary text."""
    key = hash(content)
    if key not in _counters:
        if ranks:
            import base64

            from tiktoken import Encoding

            table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
            encoding = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            _counters[key] = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(content)
            tokenizer.encode_special_tokens = True
            _counters[key] = lambda texts: [len(e.ids) for at in range(0, len(texts), 256) for e in tokenizer.encode_batch(texts[at : at + 256], add_special_tokens=False)]
    return _counters[key]


def token_counts(documents: DataFrame, tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns with `tokens`, the length of each whole text under a public tokenizer file; null texts have 0.

    The file is the one given, or that of the setting spark.tarsus.tokenizer; the driver reads it and sends it to the
    workers once.
    """
    spark = documents.sparkSession
    path = tokenizer or spark.conf.get("spark.tarsus.tokenizer", TOKENIZER)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((f.read(), path.endswith(".tiktoken")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(*shared.value)
        for batch in batches:
            yield batch.drop(columns="_text").assign(tokens=np.array(count(batch["_text"].fillna("").tolist()), np.int64))

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, F.col("text").alias("_text")).mapInPandas(run, schema + ", tokens bigint")


def plan_shares(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target source: documents, source_tokens, target_tokens and copies, the expected copies of each document.

    Shares are taken over the sources that have tokens and a positive share; the others supply nothing. Without
    `total` the mix is the largest in which every source can supply its share within its repeats. The targets are a
    list of sources, so the plan is as small.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = t.join(sizes, "source", "left").fillna(0, ["documents", "source_tokens"])
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    one = W.partitionBy(F.lit(1))
    share = F.when(usable, F.col("target_share")) / F.sum(F.when(usable, F.col("target_share"))).over(one)
    planned = joined.withColumn("share", share)
    most = F.min(F.when(usable, F.col("max_repeats") * F.col("source_tokens") / F.col("share"))).over(one)
    size = most if total is None else F.least(most, F.lit(float(total)))
    planned = planned.withColumn("target_tokens", F.coalesce(F.col("share") * size, F.lit(0.0)))
    copies = F.least(F.when(F.col("source_tokens") > 0, F.col("target_tokens") / F.col("source_tokens")), F.col("max_repeats").cast("double"))
    return planned.withColumn("copies", F.coalesce(copies, F.lit(0.0)))


def pivot(tokens: np.ndarray, part: np.ndarray, draws: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Round open parts until at most one is left between 0 and 1; sum(tokens * part) is kept."""
    out = part.copy()
    open_at = -1
    for i in range(len(out)):
        if out[i] <= eps or out[i] >= 1 - eps:
            out[i] = round(out[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = tokens[open_at], tokens[i]
        x, y = out[open_at] * a, out[i] * b
        up, down = min(a - x, y), min(x, b - y)  # tokens that can go to the first, or to the second
        if draws[i] * (up + down) < down:
            x, y = x + up, y - up
        else:
            x, y = x - down, y + down
        out[open_at], out[i] = x / a, y / b
        first, second = eps < out[open_at] < 1 - eps, eps < out[i] < 1 - eps
        for j, still in ((open_at, first), (i, second)):
            if not still:
                out[j] = round(out[j])
        open_at = open_at if first else i if second else -1
    return out


def _draw(ids: pd.Series, seed: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}|{i}".encode(), digest_size=7).digest(), "big") / 2.0**56 for i in ids])


def draw_mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, total: float | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of the drawn documents, and the plan of plan_shares.

    Documents without an id, a targeted source or any token are not drawn; a doc_id counts once in a source. The draw
    depends on ids and seed only, so a recomputed task draws the same.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = materialize(token_counts(documents.where("doc_id is not null and source is not null"), tokenizer).where("tokens > 0").dropDuplicates(["doc_id", "source"]))
    sizes = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("source_tokens"))
    plan = materialize(plan_shares(sizes, targets, total))
    blocks = max(1, -(-counted.count() // block_rows))
    copies = F.col("copies")
    open_rows = counted.join(plan.select("source", "copies").where("copies > 0"), "source")
    open_rows = open_rows.select(
        "doc_id", "source", "tokens", F.floor(copies + 1e-12).cast("int").alias("whole"), F.greatest(F.lit(0.0), copies - F.floor(copies + 1e-12)).alias("part"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    )

    def settle(level: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("doc_id")
            part = pivot(group["tokens"].to_numpy(float), group["part"].to_numpy(float), _draw(group["doc_id"], f"{seed}|{level}"))
            return group.assign(part=part)

        return run

    schema = OPEN.format(kind=kind)
    level, done = 0, []
    while True:
        rows = materialize(open_rows.groupBy("source", "block").applyInPandas(settle(level), schema))
        if blocks == 1:
            lot = F.pmod(F.xxhash64(F.lit(f"{seed}|last"), F.col("doc_id").cast("string")), F.lit(1 << 53)) / float(1 << 53)  # one open document a source
            done.append(rows.withColumn("part", F.when(F.col("part").isin(0.0, 1.0), F.col("part")).otherwise((lot < F.col("part")).cast("double"))))
            break
        done.append(rows.where("part in (0.0, 1.0)"))
        blocks, level = -(-blocks // FAN_IN), level + 1
        open_rows = rows.where("part not in (0.0, 1.0)").withColumn("block", F.floor(F.col("block") / FAN_IN))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.col("part").cast("int")).alias("copies")).where("copies > 0"), plan


def mix_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: target and actual share of the mix's tokens, documents drawn, tokens, and the most copies."""
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("drawn"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    joined = plan.join(got, "source", "left").fillna(0, ["drawn", "tokens", "most_copies"])
    actual = F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(1))))
    return joined.select("source", "target_share", "max_repeats", "documents", "source_tokens", "target_tokens", "drawn", "tokens", "most_copies", F.coalesce(actual, F.lit(0.0)).alias("actual_share"))
