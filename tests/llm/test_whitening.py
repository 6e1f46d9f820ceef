"""Whitening against plain integers and numpy, on hostile vectors."""

import math
import random
from fractions import Fraction

import numpy as np

from voxelspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string, deviation int, vector string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "clash", 1, "clash") for i, v in vectors], schema).repartition(3)


def expected(vectors, d):
    """n, sums, covariance and the x of each remaining row, from the definitions."""
    keep = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in keep})
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)]
    return keep, n, sums, np.array(cov)


def check(out, vectors, d, most=4):
    keep, n, sums, cov = expected(vectors, d)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(out) == most * len(keep)
    signs = {}
    rows = {}
    for r in out:
        rows.setdefault((r.vec_id, r.deviation_digits), []).append(r)
    for i, x in keep:
        u = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for r in rows[i, str(sum((n * a - s) ** 2 for a, s in zip(x, sums)))]:
            k = r.component - 1
            assert r.n == n and abs(r.explained / (values[k] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9
            w = float(u @ axes[:, k] / math.sqrt(values[k]))
            if abs(w) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, w * r.whitened))
                assert abs(r.whitened - sign * w) < 1e-7
    exact = sorted(str(sum((n * a - s) ** 2 for a, s in zip(x, sums))) for _, x in keep)
    assert sorted(r.deviation_digits for r in out if r.component == 1) == exact
    assert all(r.deviation is None and int(r.deviation_digits) >= 1 << 63 or str(r.deviation) == r.deviation_digits for r in out)


def vectors():
    rng = random.Random(5)
    made = [(i, [rng.gauss(0.2 * k, 1 + k) for k in range(6)]) for i in range(60)]
    made += [(100 + i, made[0][1]) for i in range(40)]  # one vector that many rows share
    made += [(7, made[3][1]), (None, made[4][1])]  # a repeated and a null id
    made += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0])]
    return made


def test_rows_equal_the_definitions(spark):
    out = W.whiten(frame(spark, vectors())).collect()
    check(out, vectors(), 6)
    assert {r.vec_id for r in out}.isdisjoint({200, 201, 202, 203, 204, 205}) and None in {r.vec_id for r in out}


def test_numbers_beyond_doubles_and_longs(spark):
    rng = random.Random(6)
    made = [(i, [rng.uniform(-1, 1) * 2.0**40 + 2.0**50, rng.uniform(-3, 3), rng.uniform(-1, 1) * 2.0**30]) for i in range(50)]
    out = W.whiten(frame(spark, made), most=2).collect()
    check(out, made, 3, 2)
    assert any(r.deviation is None for r in out)
    huge = [(i, [rng.uniform(-1, 1) * 1e300, rng.uniform(-1, 1) * 1e18]) for i in range(20)]
    schema = SCHEMA.replace("float", "double")
    out = W.whiten(frame(spark, huge, schema)).collect()  # whole numbers stop at the ends of 64 bits
    x = {tuple(min(max(math.floor(256 * c), -(1 << 63)), (1 << 63) - 1) for c in v) for _, v in huge}
    assert {r.n for r in out} == {len(x)} and all(math.isfinite(r.whitened) and r.identity_error < 1e-6 for r in out)


def test_cross_products_are_exact():
    rng = random.Random(7)
    for top in (3, 1 << 19, 1 << 25, 1 << 45, 1 << 61):
        y = np.array([[rng.randint(-top, top) for _ in range(3)] for _ in range(5000)])
        plain = y.astype(object)
        assert (W.cross_products(y) == plain.T.dot(plain)).all()
    assert (W.cross_products(plain * 4 - 1) == (plain * 4 - 1).T.dot(plain * 4 - 1)).all()


def test_few_vectors(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, []), (3, [None])])).collect() == []
    assert W.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(9)])).collect() == []  # no spread
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    out = W.whiten(frame(spark, line)).collect()
    assert {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)


def test_any_number_of_tasks_gives_the_same_model(spark):
    one, many = (W.fit(frame(spark, vectors()).repartition(k).withColumnRenamed("vector", "v").withColumnRenamed("embedding", "vector"))[1] for k in (1, 40))
    assert one.sums == many.sums and one.n == many.n and (one.axes == many.axes).all()
