"""Periodic runs: the scan and the query against a plain search of every period."""

import hashlib
import random
import zlib

import pytest
from compare import plain

from kagajflow.llm import common, op13_periodic_runs as op13


def plain_runs(words):
    """Every run by its definition: stretches of words q apart that are equal, kept where no smaller period holds."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                run = words[i : j + q]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    out.add((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, n):
    pick, out = random.Random(seed), []
    for _ in range(n):
        letters, words = pick.choice([1, 2, 3, 5, 50]), []
        while len(words) < pick.randint(0, 240):
            if pick.random() < 0.5:
                base = [pick.randrange(letters) for _ in range(pick.choice([1, 2, 3, 7, 20, 40, 60]))]
                words += (base * 6)[: pick.randint(1, 4 * len(base))]
            else:
                words += [pick.randrange(letters) for _ in range(pick.randint(1, 30))]
        out.append([b"%d" % w for w in words])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_scan(seed):
    batch = texts(seed, 6)
    batch.append(batch[0])  # a copy: shifts by whole texts match
    want = [plain_runs(words) for words in batch]
    assert op13.runs_of(batch, [(1, max(2, *map(len, batch)) // 2)] * len(batch)) == want
    parts = sum((op13.runs_of(batch[:1], [(first, first + 12)])[0] for first in range(1, len(batch[0]) // 2 + 1, 13)), [])
    assert sorted(parts, key=lambda r: (r[0], r[2])) == want[0]


def test_one_word_a_hundred_thousand_times():
    words = [b"w"] * 100_000
    assert op13.runs_of([words], [(1, 50_000)])[0] == [(0, 100_000, 1)] and op13.runs_of([words], [(100, 50_000)])[0] == []


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(kept))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, data):
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in op13.query(spark, data).collect()}
    docs = common.table(spark, data, "documents").select("doc_id", "text").collect()
    assert len(found) == len(docs) and sum(r[1] > 0 for r in found.values()) > len(docs) / 20
    for r in sorted(docs, key=lambda r: len(r["text"]))[:150]:  # the plain search is cubic
        assert found[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_ranges_of_shifts(spark, data):
    """Texts dealt in ranges of shifts have the same runs; so have repeated rows and rows without id."""
    docs = common.table(spark, data, "documents").select("doc_id", "text")
    docs = docs.union(docs.limit(5)).union(docs.selectExpr("null", "text").limit(3))
    told = lambda df: plain(df.selectExpr("doc_id", "to_json(runs) as runs", "collapsed_sha256").toPandas())
    assert told(op13.periodic_runs(docs, smear=True, lags=100)) == told(op13.periodic_runs(docs, smear=True))
