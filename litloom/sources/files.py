"""File listings, contents and the content-addressed cache of parsed documents."""

from __future__ import annotations

import hashlib
import os
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(location: str) -> str:
    """A readable path from a bare one or a ``file:`` URL; unreadable local files are an error."""
    path = location.removeprefix("file://").removeprefix("file:") if location.startswith("file:") else location
    if "://" not in path and not os.access(path, os.R_OK):
        raise FileNotFoundError(f"not readable: {location}")
    return path


def list_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """``(path)`` of the files under ``root`` whose name ends in ``suffix``, letter case aside, sorted; none for a missing root."""
    if "://" not in root and not os.path.isdir(root):
        return spark.createDataFrame([], "path string")
    found = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(root)
    return found.where(F.lower("path").endswith(suffix)).select("path").orderBy("path")


def read_bytes(spark: SparkSession, root: str, suffix: str = ".pdf", only: DataFrame | None = None) -> DataFrame:
    """``(path, sha, content)``; the key of a document in the cache is the hash of its bytes.

    With ``only(path)`` just those files are opened: paths are joined first, bytes are read afterwards in the tasks and
    take part in no shuffle."""
    if only is not None and "://" not in root.removeprefix("file://"):

        def load(batches):
            for b in batches:
                content = []
                for p in b["path"]:
                    local = p.removeprefix("file://").removeprefix("file:")
                    with open(local if os.path.exists(local) else urllib.parse.unquote(local), "rb") as f:
                        content.append(f.read())
                yield pd.DataFrame({"path": b["path"], "sha": [hashlib.sha256(c).hexdigest() for c in content], "content": content})

        return only.select("path").distinct().mapInPandas(load, "path string, sha string, content binary")
    found = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(root)
    return found.where(F.lower("path").endswith(suffix)).select("path", F.sha2("content", 256).alias("sha"), "content")


def readable(path: Column) -> Column:
    """Can a file be opened where the task runs? Null stays null; paths of other schemes than ``file`` count as readable."""

    @F.pandas_udf("boolean")
    def check(paths: pd.Series) -> pd.Series:
        def one(p: str | None) -> bool | None:
            if p is None:
                return None
            local = p.removeprefix("file://").removeprefix("file:")
            return "://" in local or os.access(urllib.parse.unquote(local), os.R_OK) or os.access(local, os.R_OK)

        return paths.map(one).astype(object)

    return check(path)


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their parsed text, misses) of ``(sha, ...)`` against ``cache(sha, tei)``; unreadable, that is null, entries are misses."""
    good = cache.where(F.col("tei").isNotNull()).groupBy("sha").agg(F.min("tei").alias("tei"))
    return files.join(good, "sha"), files.join(good, "sha", "left_anti")
