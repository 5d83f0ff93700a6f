"""Source divergence: against SQL, with small slices and few terms in the automata, and on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from compare import duck, same

from kagajflow.llm import common, op12_source_divergence as audit


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of 30 sources and languages of different sizes, with nulls, other scripts, capitals beyond ASCII and terms of any length."""
    pick = random.Random(3)
    words = {lang: [f"{lang}{i}" if i % 3 else f"É{lang}ß{'x' * i}" for i in range(40)] for lang in "abc"}
    rows = []
    for i in range(900):
        lang, source = pick.choice(["a", "a", "a", "b", "c", None]), pick.choice([None, *map(str, range(7))] if i % 3 else ["hot"])
        own = words.get(lang, ["a1", "日本"])
        text = "".join(pick.choice(own)[: pick.randint(1, 60)].title() + pick.choice([" ", ", ", "\n", "1", "_", "  "]) for _ in range(pick.randint(0, 60)))
        rows.append((i, text if i % 50 else None, lang, source))
    rows += [(None, "alone", "d", "s"), (1, "", "d", "t"), (1, "", "d", "t")]
    folder = str(tmp_path_factory.mktemp("sources"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(3).write.parquet(f"{folder}/parts")
    import duckdb

    duckdb.connect().sql(f"COPY (SELECT * FROM '{folder}/parts/*.parquet') TO '{folder}/documents.parquet'")
    return folder


@pytest.mark.parametrize("sizes", [{}, {"head": 10, "sources": 2, "terms": 4}, {"head": 0, "sources": 3, "terms": 1}])
def test_against_duckdb(spark, tables, sizes):
    found = audit.audit(common.table(spark, tables, "documents"), **sizes).toPandas()
    assert {(r.lang, r.source) for r in found.itertuples()} >= {("", "hot"), ("a", ""), ("d", "s")}
    same(found, duck(tables).sql(audit.ORACLE_SQL).df())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    same(audit.query(spark, folder).toPandas(), duck(folder).sql(audit.ORACLE_SQL).df())


def test_block_sums():
    pick = np.random.default_rng(1)
    absent, shares = pick.integers(1, 9, 5), pick.integers(1, 100, (5, 40)) * pick.integers(0, 2, (5, 40))
    full = np.where(shares > 0, shares, absent[:, None])
    rows = [(g, side, w, int(shares[g, w]) if w >= 0 else 0, int(absent[g])) for side, slice_ in ((0, (0, 1)), (1, (2, 3, 4))) for g in slice_ for w in range(-1, 40) if w < 0 or shares[g, w]]
    part = pa.table([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["g", "side", "term", "p", "absent"])
    found = {(r["s"], r["t"]): r["v"] for batch in audit.block_sums(part) for r in batch.to_pylist()}
    assert found == {(s, t): int(np.abs(full[s] - full[t]).sum() - 40 * abs(absent[s] - absent[t])) for s in (0, 1) for t in (2, 3, 4)}
