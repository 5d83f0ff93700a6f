"""Groups of rows whose pairs are looked at: dealt to tasks in slices, so that a group of any size is no task's alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Links = tuple[np.ndarray, np.ndarray]
NONE: Links = (np.zeros(0, np.int64), np.zeros(0, np.int64))
SLICE = 4096


def dealt(rows: DataFrame, keys: Sequence[str], size: str | None = None, weight: int = 1, limit: int | None = None) -> DataFrame:
    """rows with i and j: a group of the keys is dealt in slices of about `limit` rows (and `weight` of the column size), each row to every pair of slices that its own is in.

    rows have a column node, by whose hash they are sliced: every two nodes of a group meet in one of its pairs.
    """
    slices = F.count("*") / (limit or SLICE)
    slices = F.ceil(F.greatest(slices, F.sum(size) / weight) if size else slices).cast("int")
    large = rows.groupBy(*keys).agg(slices.alias("slices")).where("slices > 1")
    rows = rows.join(large, list(keys), "left").withColumn("slice", F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    return rows.withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")}).drop("slices", "slice", "other")


def linked(rows: DataFrame, keys: Sequence[str], links: Callable[[pa.Table, np.ndarray], Links]) -> DataFrame:
    """The links (a, b) that `links` finds in the groups (keys, i, j), given rows and where their groups begin and end."""
    names = [*keys, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            a, b = links(part, bounds)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held = None  # the rows of the last group, which may go on
        for batch in batches:
            if not len(batch):
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            columns = [held.column(k).to_numpy() for k in names]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            if len(cuts):
                yield found(held.slice(0, int(cuts[-1])).combine_chunks(), np.concatenate([[0], cuts]))
                held = held.slice(int(cuts[-1])).combine_chunks()
        if held is not None and len(held):
            yield found(held.combine_chunks(), np.array([0, len(held)]))

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")
