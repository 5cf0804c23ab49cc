"""Exact top-k products against plain Python."""

import math
import random

import duckdb
import numpy as np
import pytest

from pulseframe.llm import queries, top_products as module
from pulseframe.llm.top_products import query_rows, top_products
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, score int, rank string"


def brute(rows: list, every: int = 50, k: int = 5) -> list:
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, p)))), j) for b, (j, p) in enumerate(whole) if b != a]
            scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def got(df) -> list:
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    df = queries.queries()["op12_top_products"](spark, SMALL)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert got(df) == sorted(con.execute(module.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("kind", ["lengths", "clusters", "copies"])
def test_kinds_of_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(module, "SEEDS", 20)
    monkeypatch.setattr(module, "BLOCK", 32)
    monkeypatch.setattr(module, "PACK", 8)
    monkeypatch.setattr(module, "GROUP", 64)
    r = np.random.default_rng(7)
    n, d = 900, 12
    v = r.normal(size=(n, d))
    if kind == "lengths":
        v *= r.lognormal(0, 1.5, (n, 1))
    elif kind == "clusters":
        v = (r.normal(size=(15, d))[r.integers(0, 15, n)] + r.normal(size=(n, d)) * 0.05) * r.uniform(0.5, 2, (n, 1))
    else:
        v[r.random(n) < 0.4] = v[0]
    rows = list(enumerate(v.tolist()))
    random.Random(1).shuffle(rows)
    assert got(top_products(vectors(spark, rows).repartition(3), query_rows(20))) == brute(rows, 20)


def test_coordinates_are_used_and_exact():
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    centres *= 4 / np.sqrt((centres**2).sum(1))[:, None]
    v = np.floor(256 * (centres[r.integers(0, 40, 2000)] + r.normal(size=(2000, 16)) * 0.02)).astype(np.int64)
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-norm)
    v, norm = v[order], norm[order]

    def block(at, theta):
        b = object.__new__(module._Block)
        b.id = b.row = at
        b.norm, b.v = norm[at], v[at].astype(float)
        b.theta, b.tie = np.full(len(at), theta), np.full(len(at), module._LAST)
        return b

    best, p = module._Best(block(np.arange(0, 2000, 50), -(1 << 62)), 5), block(np.arange(2000), 0)
    for at in np.split(np.arange(2000), 10):
        best.search(block(at, 0))
    few = module._Best(block(np.arange(0, 2000, 50), -(1 << 62)), 5)
    few.theta[:] = best.theta
    few.tie[:] = best.tie
    with np.errstate(all="ignore"):
        cosine = few.theta / (few.q.norm * p.norm[0])
    chosen = few.by_coordinates(p, np.flatnonzero(cosine > 0.6), cosine, np.full(40, 2000))
    assert len(chosen) > 10
    products = (v @ v.T).astype(np.int64)
    for x, which in ((best, range(40)), (few, chosen)):
        for i in which:
            q = i * 50
            expected = sorted(((-s, j) for j, s in enumerate(products[q].tolist()) if j != q))[:5]
            at = x.at[0] == i
            assert list(zip((-x.at[1][at]).tolist(), x.at[2][at].tolist())) == expected


def test_odd_vectors(spark):
    r = random.Random(2)
    rows = [(None, [0.5, 0.25]), (0, None), (50, []), (100, [None, 1.0]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (250, [1.0, 2.0, 3.0]), (300, [-0.001]), (350, [0.0, 0.0]), (250, [1.0, 2.0, 3.0]), (None, [0.5, 0.25])]
    rows += [(400, [3e7, -2e7]), (401, [3e7, -2e7]), (450, [-1.0, -1.0])]
    rows += [(i, [r.uniform(-1, 1) for _ in range(r.choice([2, 2, 3]))]) for i in range(1, 40)]
    assert got(top_products(vectors(spark, rows), query_rows(50))) == brute(rows)
    few = vectors(spark, rows[6:8])
    assert got(top_products(few, query_rows(50))) == brute(rows[6:8])
    assert top_products(few.limit(0), query_rows(50)).count() == 0
    assert top_products(few, query_rows(1000)).count() == 0
    huge = got(top_products(vectors(spark, [(50, [1e300]), (1, [1e300]), (2, [-1e300])]), query_rows(50)))
    assert huge == [(50, 1, 1, 2**63 - 1), (50, 2, 2, -(2**63))]
