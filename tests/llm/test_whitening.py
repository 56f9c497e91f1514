"""Whitening against plain arithmetic: exact sums, numpy's decomposition, odd vectors."""
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from moleval.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, components=32):
    """(x, n, deviations, whitened, explained) by whole numbers and one local decomposition."""
    x = [[math.floor(Fraction(float(c)) * 64) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    c = np.array(y, float) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    at = np.argsort(-e)[:components]
    return x, n, [sum(a * a for a in r) for r in y], c @ q[:, at] / np.sqrt(e[at]), e[at] / np.trace(v)


def same(got, want):
    """Equal up to the sign of each component."""
    sign = np.sign((got * want).sum(0))
    np.testing.assert_allclose(got * sign, want, rtol=1e-6, atol=1e-6)


def test_query_against_plain_arithmetic(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    _, n, deviation, white, explained = plain([v for _, v in rows])
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    place = {i: k for k, (i, _) in enumerate(rows)}
    made = np.zeros((n, 32))
    for r in got:
        made[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-4
    same(made, white)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-4


@pytest.mark.parametrize("rows_per_block", [None, 3, 1000])
def test_odd_vectors(spark, rows_per_block):
    rng = np.random.default_rng(3)
    good = [rng.normal(size=4).tolist() for _ in range(20)]
    bad = [None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0], [1.0, 2.0], [], [1e300, 0.0, 0.0, 0.0]]
    vectors = good + [good[0]] * 15
    rows = [(i, v, "t") for i, v in enumerate(vectors)] + [(None, good[1], None)] + [(100 + i, v, "t") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string").repartition(5)
    df = df.withColumns({"index": F.lit(1), "row": F.lit(2), "whitened": F.lit(3)})
    w = whitening.whiten(df, keep=["vec_id", "x", "index", "row", "whitened"], components=3, rows_per_block=rows_per_block)
    got = sorted(((r.row.vec_id, r.x, int(r.deviation), r.whitened) for r in w.rows.collect()), key=lambda r: (r[0] is None, r[0]))
    x, n, deviation, white, explained = plain(vectors + [good[1]], 3)
    assert [r[0] for r in got] == list(range(len(vectors))) + [None]
    assert [list(r[1]) for r in got] == x and [r[2] for r in got] == deviation and w.n == n
    same(np.array([r[3] for r in got]), white)
    np.testing.assert_allclose(w.explained, explained, rtol=1e-9)
    assert w.identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [0.5, 0.5, 0.5]) for i in range(9)], [(1, None)], [(1, [])]])
def test_tables_without_variance(spark, rows):
    w = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert whitening.long_form(w).count() == 0 and w.explained == []


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [*a, 1.0, a[0]]) for i, a in enumerate(rng.normal(size=(40, 2)).tolist())]
    w = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert len(w.explained) == 2 and w.identity_error < 1e-9 and abs(sum(w.explained) - 1) < 1e-9
