"""Session helpers: the shared folder, written tables, and table loading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "taxa", "samples", "taxon_overrides", "wetland_alignments", "cached_features", "run_results", "benchmark_items", "mix_targets",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and Spark runs
    in this one process, as in tests. A cluster without the setting is an error."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.tarsus.shared.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarsus-shared-")
        spark.conf.set("spark.tarsus.shared.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, kind: str = "parquet", **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back. options: of the kind of file, for both.

    Cuts the lineage so that a lost executor costs one stage, and gives Catalyst the table's true size. The files go
    when the file system is closed at the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarsus-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.format(kind).options(**options).schema(df.schema).load(path)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """materialize(df) and the folder it lies in, for discard(). The shuffle files of the write go when it ends, not when
    the driver happens to collect its garbage."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark)}/tarsus-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of written() that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path of ours."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tarsus-code-")) / "tarsus_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def local_session(cores: str | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tarsus")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
