"""Whitening against a full decomposition, and the parts of the eigenvalue search."""

from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from rivulint.llm import feast_whitening as fw
from rivulint.llm import queries

FIELDS = "vec_id long, embedding array<float>"


def plain(vectors):
    """{width: (n, S, covariance, values, components)} and the integer vectors of the rows."""
    groups, rows = defaultdict(set), []
    for vec_id, vector, *_ in vectors:
        if not vector or any(c is None or not math.isfinite(c) for c in vector):
            continue
        x = tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)
        rows.append((vec_id, x))
        groups[len(x)].add(x)
    known = {}
    for width, fit in groups.items():
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        far = np.array([[n * a - s for a, s in zip(x, sums)] for x in sorted(fit)], dtype=float) / n
        cov = far.T @ far / n
        values, vecs = np.linalg.eigh(cov)
        some = values > 1e-12 * max(values.max(), 1e-300)
        known[width] = n, sums, cov, values[some][::-1][:16], vecs[:, some][:, ::-1][:, :16]
    return known, rows


def check(found, vectors):
    known, rows = plain(vectors)
    want = sum(len(known[len(x)][3]) for _, x in rows)
    assert len(found) == want
    by_row = defaultdict(list)
    for r in found:
        by_row[r.vec_id].append(r)
    signs = {}
    for vec_id, x in rows:
        n, sums, cov, values, vecs = known[len(x)]
        mine = sorted(by_row[vec_id], key=lambda r: r.component)
        copies = len(mine) // max(1, len(values))
        far = [n * a - s for a, s in zip(x, sums)]
        scores = (np.array(far, dtype=float) / n) @ vecs / np.sqrt(values)
        for at, r in enumerate(mine):
            c = at // copies
            assert r.component == c + 1 and r.n == n
            assert int(r.deviation) == sum(f * f for f in far)
            assert abs(r.explained - values[c] / np.trace(cov)) <= 1e-10
            assert r.identity_error <= 1e-9
            if abs(scores[c]) > 1e-6:
                sign = signs.setdefault((len(x), c), np.sign(scores[c] * r.whitened))
                assert abs(r.whitened - sign * scores[c]) <= 1e-6 * max(1, abs(scores[c]))


def test_the_tables_vectors(spark):
    for sf in ("sf0.001", "sf0.1"):
        vectors = duckdb.sql(f"SELECT vec_id, embedding FROM "
                             f"'/root/testdata/{sf}/embeddings.parquet'").fetchall()
        df = queries.QUERIES["op12_feast_whitening"](spark, f"/root/testdata/{sf}")
        assert dict(df.dtypes) == {
            "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
            "whitened": "double", "explained": "double", "identity_error": "double"}
        check(df.collect(), vectors)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]                       # copies
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5),
             (204, [float("inf")] * 5), (205, [0.0] * 5), (None, rows[1][1])]
    rows += [(300 + i, [float(i), 2.0 * i, 1.0]) for i in range(9)]          # width 3, rank 1
    rows += [(400, [1.0, 2.0])]                                              # alone
    rows += [(500 + i, [1e13 * float(v) for v in rng.standard_normal(2)] + [0.5] * 2)
             for i in range(9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], FIELDS + ", n int")
    found = fw.whitened(df)
    check(found.collect(), rows)
    assert found.where("vec_id = 400 or vec_id = 201").count() == 0
    assert found.where("vec_id is null").count() == 5
    assert fw.whitened(df.where("false")).count() == 0


def matrix(kind):
    rng = np.random.default_rng(7)
    if kind == "noise":
        a = rng.standard_normal((3000, 40))
        m = a.T @ a / 3000
    else:
        values = {"clusters": [5.0] * 12 + [1.0] * 28, "falling": [0.5 ** i for i in range(40)],
                  "rank": [3.0, 2.0] + [0.0] * 38, "near": [1 + 1e-9 * i for i in range(40)]}[kind]
        q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
        m = q * values @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("kind", ["noise", "clusters", "falling", "rank", "near"])
def test_no_eigenvalue_is_missed(kind):
    m = matrix(kind)
    want = np.linalg.eigvalsh(m)[::-1]
    for shift in (0.3, 0.7, 1.5, float(want.mean()) * 1.01):
        assert fw.eigenvalues_above(m, shift) == (want > shift).sum()
    values, vectors = [], []
    for low, high, count in fw.leading_intervals(m, 16):
        got = fw.in_interval(m, low, high, count)
        assert len(got[0]) == count
        values += got[0].tolist()
        vectors.append(got[1])
    values, vectors = np.array(values), np.hstack(vectors)
    assert len(values) >= min(16, (want > 1e-12).sum())
    assert np.abs(np.sort(values)[::-1] - want[: len(values)]).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12


def test_wide_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((600, 96)) * np.linspace(3, 0.2, 96)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    check(fw.whitened(spark.createDataFrame(rows, FIELDS)).collect(), rows)
