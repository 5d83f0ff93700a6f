"""Comparison of Spark results with DuckDB's on the same Parquet files."""

from pathlib import Path

import duckdb
import pandas as pd


def duck(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(frame):
    """Rows as sorted tuples, columns by name, numbers rounded."""
    frame = frame[sorted(frame.columns)]

    def value(x):
        if hasattr(x, "tolist") and getattr(x, "shape", ()) != ():
            return tuple(x.tolist())
        if pd.isna(x):
            return None
        if isinstance(x, float):
            return round(x, 6)
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(value(x) for x in row) for row in frame.itertuples(index=False)), key=repr)


def same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    ours, theirs = plain(spark_frame), plain(duck_frame)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert [float(x) if isinstance(x, (int, bool)) and not isinstance(x, str) else x for x in a] == [float(x) if isinstance(x, (int, bool)) and not isinstance(x, str) else x for x in b]
