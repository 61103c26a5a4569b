"""COCO metadata, archives and images (SRC10-SRC15, SRC19-SRC23). Downloads (SRC16-SRC18) are connector stubs."""

from __future__ import annotations

import json
import re
import stat
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = {
    "images": "array<struct<id:string,file_name:string,width:int,height:int>>",
    "annotations": "array<struct<id:string,image_id:string,category_id:int,bbox:array<double>>>",
    "categories": "array<struct<id:int,name:string>>",
}
MARKS = np.zeros(256, np.int8)  # what opens is 1, what closes -1, a comma 2
for _c, _v in ((b"[", 1), (b"{", 1), (b"]", -1), (b"}", -1), (b",", 2)):
    MARKS[_c[0]] = _v


def array_parts(stream: BinaryIO, size: int = 1 << 16) -> Iterator[tuple[str, str]]:
    """(name, JSON array): the arrays of a JSON object, each cut between elements into arrays of about size bytes. The
    stream is read once, and no more of it is held than a part. Elements are only cut apart, what lies around them has
    to be one JSON object without repeated keys."""
    depth, inside, odd = 0, False, False  # inside: in a string; odd: the bytes so far end with an open escape
    name, parts, held, rest = None, 0, bytearray(), bytearray()  # rest: the document without the arrays' elements

    def part(last: bool) -> list[tuple[str, str]]:
        nonlocal parts
        text = held.decode("utf-8")
        if not text.strip():
            if parts or not last:
                raise ValueError(f"an element of {name} is missing")
            return []
        parts += 1
        return [(name, f"[{text}]")]

    while chunk := stream.read(size):
        a = np.frombuffer(chunk, np.uint8)
        quote = a == ord('"')
        if odd or b"\\" in chunk:
            slashes = np.flatnonzero(a == ord("\\"))
            gap = np.diff(slashes) > 1
            first, last = slashes[np.append(True, gap)[: len(slashes)]], slashes[np.append(gap, True)[: len(slashes)]]
            length = last - first + 1
            if odd and len(first) and first[0] == 0:
                length[0] += 1
            elif odd:
                quote[0] = False
            after = last[length % 2 == 1] + 1
            quote[after[after < len(a)]] = False
            odd = bool(len(after)) and int(after[-1]) == len(a)
        string = (np.cumsum(quote) + inside) % 2
        inside = bool(string[-1])
        mark = MARKS[a]
        at = np.flatnonzero(mark)
        at = at[string[at] == 0]
        step = np.where(mark[at] == 2, 0, mark[at])
        deep = depth + np.cumsum(step)
        depth = int(deep[-1]) if len(deep) else depth
        pos = 0
        for i in at[((deep == 2) & (step == 1)) | ((deep == 1) & (step == -1))].tolist():
            if name is not None:
                held += chunk[pos:i]
                yield from part(True)
                name, held, pos = None, bytearray(), i
            rest += chunk[pos : i + 1]
            pos = i + 1
            if chunk[i] == ord("[") and (key := re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\[$', rest)):
                name, parts = json.loads(b'"' + key[1] + b'"'), 0
        if name is None:
            rest += chunk[pos:]
            continue
        commas = at[(deep == 2) & (step == 0) & (at >= pos)]
        if len(commas):
            held += chunk[pos : commas[-1]]
            yield from part(False)
            held, pos = bytearray(), int(commas[-1]) + 1
        held += chunk[pos:]

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    if not isinstance(json.loads(rest.decode("utf-8-sig"), object_pairs_hook=once), dict):
        raise ValueError("a document has to be an object")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC10: (images, annotations, categories) of COCO documents, one table an array. A document is cut between the
    elements of its arrays as a stream, in one task and bounded memory, where it lies (compressed ones by their suffix,
    and any file system that Arrow knows); its parts are written to the shared folder and parsed in parallel. They are
    lines there, each the array's name and a part: a task holds one at a time, where a columnar file holds pages and
    batches of them, in the heap and beside it. What ends a line can't be part of a JSON text; if it is, parsing fails."""
    from tarsus.runtime import materialize, ship

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        n = 0
        for batch in batches:
            for name in batch["path"]:
                files, at = fs.FileSystem.from_uri(name)
                with files.open_input_stream(at, compression="detect") as stream:
                    lines = (f"{array} {text}" for array, text in array_parts(stream) if array in COCO)
                    while some := list(islice(lines, 8)):
                        yield pd.DataFrame({"part": range(n, n + len(some)), "value": some})
                        n += len(some)

    ship(spark)
    found = spark.read.format("binaryFile").load(path).select("path")
    parts = materialize(found.mapInPandas(run, "part bigint, value string").repartition("part").select("value"), "text", compression="snappy", lineSep="\x1e")
    text = lambda c: F.substring("value", len(c) + 2, (1 << 31) - 1)
    return tuple(parts.where(F.col("value").startswith(f"{c} ")).select(F.explode(F.from_json(text(c), schema, {"mode": "FAILFAST"})).alias("_x")).select("_x.*") for c, schema in COCO.items())


def coco_plan(images: DataFrame, annotations: DataFrame, categories: DataFrame, generic: tuple[str, ...] = ("empty", "bird")) -> DataFrame:
    """CMP1-CMP4: typed crops: annotation, image, category, and the box as corners clipped to the image.

    Generic and empty categories are left out; boxes that miss the image are left out too. Unknown images or categories:
    see manifest.unknown_keys.
    """
    from tarsus.functions.geometry import clip, to_corners

    named = annotations.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id").where(~F.lower("category").isin(*generic))
    j = named.select("id", "image_id", "category", to_corners(F.col("bbox")).alias("_box")).join(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id")
    cut = clip(F.col("_box"), F.col("width"), F.col("height"))
    return j.withColumn("box", cut).where("box is not null").select("id", "image_id", "file_name", "category", "box", (F.col("box") != F.col("_box")).alias("changed"))


def plan_counts(images: DataFrame, annotations: DataFrame, categories: DataFrame, plan: DataFrame) -> DataFrame:
    """CMP1-CMP4: (item, found): what a plan has to count, to be held against expected numbers."""
    crops = plan.agg(F.count(F.lit(1)).alias("crops"), F.count_distinct("category").alias("taxa"), F.count_distinct("image_id").alias("used_images"), F.count_if("changed").alias("clipped"))
    parts = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in (("images", images), ("annotations", annotations), ("categories", categories))]
    row = crops
    for p in parts:
        row = row.crossJoin(p)  # one row each
    return row.unpivot([], list(row.columns), "item", "found")


def unexpected_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """CMP1-CMP4, VAL2: (item, expected, found) where a count is another than expected, or missing."""
    j = expected.join(counts, "item", "full")
    return j.where(~F.col("expected").eqNullSafe(F.col("found"))).select("item", "expected", "found")


def supercategory(categories: DataFrame, annotations: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """FIL5: the categories of one supercategory, and the annotations, hence images, that they retain."""
    kept = categories.where(F.col("supercategory") == name)
    return kept, annotations.join(kept.select(F.col("id").alias("category_id")), "category_id", "left_semi")


def tar_json(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    """SRC11: the JSON members of tar.gz archives whose names end with a suffix, under a declared schema; they are read
    where the archives lie. A member that doesn't parse, or an archive without one, fails."""

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                    found = [t.extractfile(m).read().decode("utf-8") for m in t if m.isfile() and m.name.endswith(suffix)]
                if not found:
                    raise ValueError(f"{name} has no member {suffix}")
                rows += [(name, text) for text in found]
            yield pd.DataFrame(rows, columns=["archive", "text"])

    texts = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, text string")
    return texts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_j")).select("_j.*")


def checked_names(archive: zipfile.ZipFile) -> list[str]:
    names: list[str] = []
    for info in archive.infolist():
        if info.is_dir():
            continue
        p = PurePosixPath(info.filename)
        if p.is_absolute() or ".." in p.parts or "\\" in info.filename:
            raise ValueError(f"unsafe path {info.filename}")
        if info.flag_bits & 1:
            raise ValueError(f"encrypted member {info.filename}")
        if stat.S_ISLNK(info.external_attr >> 16):
            raise ValueError(f"symbolic link {info.filename}")
        names.append(info.filename)
    if len(set(names)) != len(names):
        raise ValueError("a member is repeated")
    return names


def zip_members(path: str) -> list[str]:
    """SRC13: member names of a ZIP whose every member is a plain, unencrypted file at a safe relative path, once."""
    with zipfile.ZipFile(path) as z:
        return checked_names(z)


def member_problems(spark: SparkSession, path: str, expected: DataFrame, column: str) -> DataFrame:
    """SRC14, VAL26: expected members an archive lacks, and members nobody expects. Archives are read where they lie."""
    from tarsus.operators.manifest import key_mismatches
    from tarsus.runtime import ship

    def run(batches):
        import io

        import pandas as pd

        for batch in batches:
            names = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names += checked_names(z)
            yield pd.DataFrame({column: names})

    ship(spark)
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"{column} string")
    return key_mismatches(expected, found, column)


def zip_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """SRC11, SRC12, SRC15: (archive, member, text) of the text members of ZIP archives, read where the archives lie."""

    from tarsus.runtime import ship

    ship(spark)

    def run(batches):
        import io

        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:  # reading a member checks its CRC
                    rows += [(name, n, z.read(n).decode("utf-8")) for n in checked_names(z) if n.endswith(suffix)]
            yield pd.DataFrame(rows, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def annotation_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """SRC12, STR10: (split, category, frame, object, label) of lines `images/split/category/frame_object.png label`."""
    grammar = r"^images/([^/\s]+)/([^/\s]+)/([^/\s]+)_(\d+)\.png\s+(\S+)$"
    lines = texts.select(F.explode(F.split(text, "\n")).alias("_l")).where(F.trim("_l") != "")
    part = lambda i: F.regexp_extract(F.trim("_l"), grammar, i)
    return lines.select(part(1).alias("split"), part(2).alias("category"), part(3).alias("frame"), F.nullif(part(4), F.lit("")).cast("int").alias("object"), part(5).alias("label"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """SRC22: (path, length, sha256, content) of image files; decoding needs an imaging library, which is optional."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def download(url: str, target: str) -> None:
    """SRC16-SRC18: a connector for verified downloads; this engine is used without a network."""
    raise NotImplementedError(f"no network connector is configured for {url} -> {target}")
