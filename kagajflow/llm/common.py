"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine (tests) a new temporary one is set if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Days after which what a session has stored is removed by the next one that stores something.
LEASE_DAYS = 7
RUN = uuid.uuid4().hex
SWEPT: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """This session's part of the shared folder. Parts that nothing was written to for LEASE_DAYS are removed when it is first asked for."""
    top = f"{shared_dir(spark).rstrip('/')}/kagajflow-llm"
    if top not in SWEPT:
        SWEPT.add(top)
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            for old in files.listStatus(path):
                if old.getModificationTime() < (time.time() - LEASE_DAYS * 86400) * 1000:
                    files.delete(old.getPath(), True)
    return f"{top}/{spark.sparkContext.applicationId}-{RUN}"


def clear(spark: SparkSession) -> None:
    """Removes all that this session has stored: for when its results are written."""
    remove(spark, run_folder(spark))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder once and read back: later uses neither recompute it nor depend on its executors."""
    return stored_parts(iter([df]), name)


def stored_parts(frames: Iterator[DataFrame], name: str) -> DataFrame:
    """The rows of all frames (one at least), written to the shared folder one frame after the other and read back as one."""
    path = ""
    for df in frames:
        path = path or f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) of about `limit` bytes each; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_key() -> Column:
    """What a row of documents is known by: its id and, as ids may repeat, its text's hash."""
    return F.struct(F.col("doc_id").alias("doc_id"), text_hash(F.col("text")).alias("h"))


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs but for the rows that have one of the keys (doc_id, h)."""
    gone = keys.select("doc_id", "h").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (text_hash(docs["text"]) == gone["h"]), "left_anti")


def with_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs that have one of the keys (doc_id, h): a share of all rows, so never broadcast."""
    kept = keys.select("doc_id", "h").hint("merge")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]) & (text_hash(docs["text"]) == kept["h"]), "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name
