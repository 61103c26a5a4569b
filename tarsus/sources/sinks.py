"""Write-once sinks, canonical digests and checksum manifests (SNK1-SNK9)."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK1: JSON lines with sorted keys; an existing target is an error, and the committer makes the write atomic."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK3: CSV with header; no rows are an error."""
    if df.isEmpty():
        raise ValueError("nothing to export")
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, key: str) -> str:
    """SNK2: Parquet in key order by range, and the content digest of its rows."""
    from tarsus.operators.manifest import content_digest

    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    found = content_digest(df.sparkSession.read.parquet(path).withColumn("_all", F.lit(1)), ["_all"], key, row).first()
    return found["digest"] if found else ""


def checksums(spark: SparkSession, directory: str) -> DataFrame:
    """SNK6: (name, sha256) of the files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(F.substring_index("path", directory.rstrip("/") + "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def checksum_problems(spark: SparkSession, directory: str, recorded: DataFrame) -> DataFrame:
    """SNK6, VAL15, VAL19: files that are missing, extra or changed against a recorded list."""
    j = recorded.select("name", F.col("sha256").alias("_r")).join(checksums(spark, directory).withColumnRenamed("sha256", "_f"), "name", "full")
    return j.select("name", F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "extra").when(F.col("_f") != F.col("_r"), "changed").alias("problem")).where("problem is not null")


def run_directory(root: str, config: dict) -> Path:
    """SNK5: a new directory named after the time-free digest of its configuration, which is written into it."""
    import hashlib

    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    path = Path(root) / hashlib.sha256(text.encode()).hexdigest()[:16]
    path.mkdir(parents=True)
    (path / "config.json").write_text(text + "\n", encoding="utf-8")
    return path


def write_bundle(target: str, files: dict[str, str]) -> None:
    """SNK7, SNK9: several small files, all or none: staged beside the target and renamed."""
    final = Path(target)
    if final.exists():
        raise FileExistsError(target)
    stage = final.with_name(f".{final.name}-{uuid.uuid4().hex}")
    stage.mkdir(parents=True)
    try:
        for name, text in files.items():
            (stage / name).write_text(text, encoding="utf-8")
        os.rename(stage, final)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def markdown(df: DataFrame, columns: tuple[str, ...], most: int = 200) -> str:
    """SNK9: a Markdown table of a report; reports are bounded, and a longer one is an error."""
    rows = df.select(*columns).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"
