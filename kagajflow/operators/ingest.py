"""Writing chunks: idempotent loads partitioned by book."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import DIGITS


def numbered(chunks: DataFrame, by: str, order: str, start: int = 0) -> DataFrame:
    """chunks with chunk_index from `start` within each document."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1 + start)


def not_yet_loaded(chunks: DataFrame, loaded: DataFrame, key: str = "filename") -> DataFrame:
    """The chunks of documents that aren't loaded."""
    return chunks.join(loaded.select(key).distinct(), key, "left_anti")


def after(chunks: DataFrame, loaded: DataFrame, key: str = "filename") -> DataFrame:
    """The chunks behind those that a broken-off load has written."""
    have = loaded.groupBy(key).agg(F.count("*").alias("_have"))
    return chunks.join(have, key, "left").where(F.col("chunk_index") >= F.coalesce("_have", F.lit(0))).drop("_have")


def load(chunks: DataFrame, path: str, partition: str = "book_id") -> None:
    """Replaces the partitions that chunks has rows of and leaves all others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def adapted(chunks: DataFrame, target: StructType) -> tuple[DataFrame, list[str], list[str]]:
    """chunks with the target's columns, cast to its types and null where chunks have none, and the names of the columns that are dropped and of those that are added."""
    known = {f.name: f.dataType for f in target.fields}
    columns = [(F.col(f"`{name}`") if name in chunks.columns else F.lit(None)).cast(kind).alias(name) for name, kind in known.items()]
    return chunks.select(columns), [c for c in chunks.columns if c not in known], [c for c in known if c not in chunks.columns]


@dataclass(frozen=True)
class Loaded:
    """What a load did: how often it was tried, and which columns the table doesn't have or lacked."""

    tries: int
    dropped: tuple[str, ...] = ()
    added: tuple[str, ...] = ()
    widened: tuple[str, ...] = ()


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that batches were loaded into; columns that a batch lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("load_batch")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return loaded(spark, path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_batch(chunks: DataFrame, path: str, batch: str, widen: bool = False, tries: int = 5, wait: float = 2.0, most: float = 30.0, write: Callable[[DataFrame, str], None] | None = None, pause: Callable[[float], None] = time.sleep) -> Loaded:
    """Adds a batch of chunks to a table, whose schema decides: unknown columns go, missing ones are null; with `widen` unknown columns are added to the table.

    The batch's name makes a repeat harmless: its rows replace those of an earlier try. A failed try is repeated after a pause that doubles
    from `wait` seconds up to `most`; the schema is read anew each time, so columns that the table has got meanwhile count.
    """
    spark = chunks.sparkSession
    for n in range(1, tries + 1):
        try:
            table = existing(spark, path)
            rows, dropped, added = (chunks, [], []) if table is None else adapted(chunks, table.schema)
            widened = dropped if widen else []
            if widened:
                rows, dropped, _ = adapted(chunks, StructType([*table.schema.fields, *(chunks.schema[c] for c in widened)]))
            named = rows.withColumn("load_batch", F.lit(batch))
            if write is None:
                named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_batch").parquet(path)
            else:
                write(named, path)
            return Loaded(n, tuple(dropped), tuple(added), tuple(widened))
        except Exception:
            if n == tries:
                raise
            pause(min(most, wait * 2 ** (n - 1)))
    raise ValueError("a load needs one try at least")


def wipe(spark: SparkSession, path: str) -> None:
    """Empties a table, keeping its columns."""
    table = spark.read.parquet(path)
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


def without_documents(documents: DataFrame, chunks: DataFrame, filenames: DataFrame, key: str = "filename") -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the given files (filename): what stays when a rule's files are replaced."""
    gone = filenames.select(key).distinct()
    return documents.join(gone, key, "left_anti"), chunks.join(gone, key, "left_anti")


def load_all(parts: Mapping[str, Callable[[], DataFrame]], path: str, partition: str = "book_id", attempts: int = 3) -> dict[str, str]:
    """Loads each rule's chunks, trying again where a load fails; the rules that failed in the end, with their last errors.

    Rules are a handful of books; each load is a job of its own and replaces its own partitions only.
    """
    failed: dict[str, str] = {}
    for name, chunks in parts.items():
        for _ in range(attempts):
            try:
                load(chunks(), path, partition)
            except Exception as error:  # noqa: BLE001  whatever fails is reported, the other rules go on
                failed[name] = str(error)
            else:
                failed.pop(name, None)
                break
    return failed


def ingest_rows(parsed: DataFrame, filename: Column, book_id: Column) -> DataFrame:
    """Parsed statute chunks (parse_statutes) as rows of the chunks table: label, chapter, title, content and metadata as JSON."""
    metadata = F.to_json(F.struct("chunk_id", "chunk_type", "bhag", "parichhed", F.col("dafa").alias("section_dafa"), F.col("upadafa").alias("subsection_upadafa"), F.col("khanda").alias("clause_khanda"), "references"))
    return parsed.select(
        "chunk_index", filename.alias("filename"), book_id.alias("book_id"), F.translate("dafa", DIGITS, "0123456789").alias("section_label"), F.col("parichhed").alias("chapter"), F.col("dafa_title").alias("section_title"),
        F.concat(F.lit("("), "upadafa", F.lit(")")).alias("subsection"), "content", metadata.alias("metadata"),
    )
