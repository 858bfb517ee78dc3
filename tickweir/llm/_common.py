"""Helpers that the operators share: column picking, shared folder, identities."""

from __future__ import annotations

import os
import shutil
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ship(module: str) -> None:
    """Send a module's functions to the Python workers by value, so that they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: The most that one batch between the JVM and a Python worker may hold: rows and bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH. Each batch is held several times over, in the JVM and in Python."""
    for name, most in BATCH.items():
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact name, first match; other columns may clash with them in case or be repeated. Every
    operator begins with it, so it also sees to small batches."""
    small_batches(df.sparkSession)
    have = df.columns
    missing = [n for n in names if n not in have]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    if len({c.lower() for c in have}) == len(have):
        return df.select(*[F.col(f"`{n}`") for n in names])
    at = {n: have.index(n) for n in names}
    return df.toDF(*[f"c{i}" for i in range(len(have))]).select(*[F.col(f"c{i}").alias(n) for n, i in at.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir (which all executors see). Where that is unset and Spark runs in one
    process on one machine, as in tests, it is set to a folder below the warehouse directory; elsewhere that is so only if
    the warehouse isn't in a machine's own file system, as other executors couldn't see it."""
    jsc = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = jsc.getCheckpointDir()
        if not held.isDefined():
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            alone = spark.sparkContext.master.split("[")[0] == "local"
            if not alone and qualified(spark, warehouse).startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            spark.sparkContext.setCheckpointDir(warehouse + "/_shared")
            held = jsc.getCheckpointDir()
        root = held.get()
    return f"{qualified(spark, root).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, uri: str) -> str:
    """A URI with its file system's scheme; a path without one is of the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a URI or a bare path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Within it, what `materialise` writes is deleted at the end; nothing may read it afterwards."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(path)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. The rows outlive any executor. The table stays until
    `discard`, the end of a `scratch`, or for as long as the folder is kept."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._shared = path
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return held


def put(fs: pafs.FileSystem, part: str, target: str) -> None:
    """Give a finished file its name, in place of what an earlier attempt left there."""
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        fs.delete_file(target)
    fs.move(part, target)


def remove(uri: str) -> None:
    """Delete a folder, if it is there."""
    fs, p = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        shutil.rmtree(p, ignore_errors=True)
    elif fs.get_file_info(p).type != pafs.FileType.NotFound:
        fs.delete_dir(p)


def discard(table: DataFrame) -> None:
    """Delete what `materialise` wrote, once nothing reads it any more."""
    remove(table._shared)


def worker_held(kind: str, key: object, make: Callable[[], T]) -> T:
    """What make() gives, kept in this Python worker from task to task; the last key of a kind only."""
    held = sys.modules.setdefault("_tickweir_held", types.ModuleType("_tickweir_held")).__dict__
    if kind not in held or held[kind][0] != key:
        held[kind] = (key, make())
    return held[kind][1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(key: str, salt: str) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 of a column and a salt, the same in any engine."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


ship(__name__)
