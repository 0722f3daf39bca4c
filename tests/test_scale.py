"""Operators that cut long keys into chunks, against plain versions, with small chunks, nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subseqrules.functions import kernels as K
from subseqrules.operators import intervals as I
from subseqrules.operators import motifs as M
from subseqrules.operators import pairs as P
from subseqrules.operators import series as S

R = np.random.default_rng(17)
SERIES = "series_id string, attr_id int, t long, v double"


def plain_pick(rows):
    """rows of (at, delta, lam, gap) of one key."""
    out = []
    for r in sorted(rows):
        if not out or r[0] >= out[-1][0] + out[-1][3]:
            out.append(r)
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 1 << 16])
def test_greedy_rows(spark, width):
    data = [(k, int(t), int(d), float(d % 3)) for k, n, top in (("a", 300, 900), ("b", 40, 30), (None, 60, 200), ("c", 1, 5)) for t, d in zip(R.integers(-50, top, n), R.integers(0, 25, n))]
    data += [("a", 5, 2, 0.0)] * 3
    rows = spark.createDataFrame([(*r, "clash", 3) for r in data], "k string, t1 long, delta int, lam double, x string, place int").drop("place")
    for gap in (F.col("delta") + 1, F.lit(4)):
        got = {}
        for r in I.greedy_rows(rows, ["k"], ["t1", "delta", "lam"], gap, width).collect():
            got.setdefault(r.k, []).append((r.place, r.t1, r.delta, r.lam))
            assert r.x == "clash"
        for k in ("a", "b", "c", None):
            want = plain_pick([(t, d, x, 4 if "4" in str(gap) else d + 1) for q, t, d, x in data if q == k])
            assert sorted(got[k]) == [(n, *w[:3]) for n, w in enumerate(want)]


def test_greedy_rows_odd(spark):
    none = spark.createDataFrame([], "k string, t1 long, delta int, lam double")
    assert I.greedy_rows(none, ["k"], ["t1"], F.lit(1)).count() == 0 and M.sweep(none, ["k"]).count() == 0
    rows = spark.createDataFrame([("a", None, 1, 0.0), ("a", 3, None, 0.0), ("a", 2, 1, 0.0), ("a", 2, 1, 0.0)], "k string, t1 long, delta int, lam double")
    assert [(r.t1, r.place) for r in I.greedy_rows(rows, ["k"], ["t1"], F.col("delta")).collect()] == [(2, 0)]
    same = I.greedy_rows(rows.where("t1 = 2 or delta is null"), ["k"], ["t1"], F.lit(0)).collect()  # nothing is too near
    assert [r.t1 for r in sorted(same, key=lambda r: r.place)] == [2, 2, 3]


def test_orbit_exits_are_short():
    t = np.unique(R.integers(0, 20_000, 9000))
    reach = t + R.integers(5, 60, len(t))
    places, out, count = K.orbit_exits(t, reach, 100)
    assert len(places) <= 101 and places[-1] >= 100
    for at in range(100):
        i, n = int(np.searchsorted(t, at)), 0
        while i < len(t):
            i, n, end = K.orbit(t, reach)[i], n + 1, reach[i]
        j = int(np.searchsorted(places, at))
        assert (out[j], count[j]) == (end, n)


@pytest.mark.parametrize("chunk", [3, 10, 1 << 16])
@pytest.mark.parametrize("m", [1, 2, 5, 25])
def test_sliding_in_chunks(spark, chunk, m):
    v = {("a", 0): R.normal(size=60), ("b", 1): R.normal(size=24), ("flat", 0): np.ones(30)}
    rows = spark.createDataFrame([(*k, t, float(x)) for k, y in v.items() for t, x in enumerate(y)], SERIES).repartition(3)
    got = {(r.series_id, r.t): (r["mean"], r["std"], r.sumsq, r.complexity) for r in S.sliding(rows, m, chunk).collect()}
    want = {}
    for (k, _), y in v.items():
        for t in range(len(y) - m + 1):
            w = y[t : t + m]
            want[k, t] = (w.mean(), 0.1 if w.std() < 1e-4 else w.std(), (w * w).sum(), (np.diff(w) ** 2).sum())
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_statistics_of_hot_null_and_many_series(spark):
    data = [("hot", 0, t, float(t % 7)) for t in range(3000)] + [(None, 1, t, float(t)) for t in range(5)] + [(f"s{k}", None, t, float(k + t)) for k in range(1200) for t in range(2)]
    rows = spark.createDataFrame(data, SERIES)
    got = S.with_statistics(rows, top=F.max("v"), n=F.count("*")).collect()
    assert len(got) == len(data) and [c for c in got[0].asDict()] == ["series_id", "attr_id", "t", "v", "top", "n"]
    for r in got:
        assert (r.top, r.n) == ((6.0, 3000) if r.series_id == "hot" else (4.0, 5) if r.series_id is None else (float(r.series_id[1:]) + 1, 2))
    assert S.zscore(rows.limit(0)).count() == 0
    z = np.array([r.v for r in S.zscore(rows.where("series_id = 'hot'")).collect()])
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9


@pytest.mark.parametrize("case", ["full", "constant", "twice", "few", "wide", "one"])
def test_least_squares_from_moments(spark, case):
    x = R.normal(size=(2 if case == "few" else 1 if case == "one" else 50, 3)) * [1, 1000, 0.01] + [5, -2e4, 1]
    if case == "constant":
        x[:, 1] = 3.0
    elif case == "twice":
        x[:, 2] = 2 * x[:, 0]
    y = x @ R.normal(size=(3, 2)) + R.normal(size=(len(x), 2)) + 7
    want = K.least_squares(x, y)
    rows = spark.createDataFrame([("k", *map(float, a), *map(float, b), "clash") for a, b in zip(x, y)] + [("k", None, 1.0, 1.0, 1.0, 1.0, "null"), (None, 1.0, 2.0, 3.0, 4.0, 5.0, "")], "k string, a double, b double, c double, p double, q double, coef string").repartition(4)
    got = {r.k: np.array(r.coef).T for r in P.multi_output_lstsq(rows, ["k"], ["a", "b", "c"], ["p", "q"]).collect()}
    assert np.allclose(got["k"], want, rtol=1e-5, atol=1e-6 * np.abs(want).max())
    assert np.allclose(got[None], K.least_squares(np.array([[1.0, 2, 3]]), np.array([[4.0, 5]])))


def test_polynomials(spark):
    rows = spark.createDataFrame([(k % 2, float(x), float(1 + 2 * x - 3 * x**2 + 0.5 * x**3)) for k, x in enumerate(np.linspace(-2, 2, 40))], "k int, x double, y double")
    for r in P.poly_fit(rows, ["k"]).collect():
        assert np.allclose(r.coef, [1, 2, -3, 0.5])
    assert P.poly_fit(rows.limit(0), ["k"]).count() == 0


def test_nearest_start_with_large_ids(spark):
    left = spark.createDataFrame([("k", 2**40, 10)], "key string, id long, at long")
    right = spark.createDataFrame([("k", 2**50, 7), ("k", 2**50 + 1, 30)], "key string, occ_id long, t1 long")
    assert [tuple(r) for r in I.nearest_start(left, right, ["key"]).collect()] == [("k", 2**40, 10, 7, 2**50)]


def test_longest_free_run_takes_the_first(spark):
    ranges = spark.createDataFrame([("k", 0, 30)], "k string, lo long, hi long")
    blocked = spark.createDataFrame([("k", 10, 20)], "k string, a long, b long")
    assert [tuple(r) for r in I.longest_free_run(ranges, blocked, ["k"], 11).collect()] == [("k", 0, 10, True)]


@pytest.mark.parametrize("width", [1, 5, 40, 10**6])
def test_intervals_in_chunks(spark, width):
    data = [(k, int(a), int(a + n)) for k, m, top in (("a", 80, 300), ("b", 60, 60), (None, 20, 100)) for a, n in zip(R.integers(-20, top, m), R.integers(0, 12, m))] + [("long", 0, 500), ("long", 499, 501), ("long", 502, 502), ("long", 501, 510), ("long", 600, 601)]
    rows = spark.createDataFrame(data, "k string, a long, b long").repartition(3)
    one, many = ([tuple(r) for r in I.merge_intervals(rows, ["k"], w).collect()] for w in (None, width))
    want = []
    for k in ("a", "b", None, "long"):
        own = []
        for _, a, b in sorted((x for x in data if x[0] == k and x[2] > x[1]), key=lambda x: x[1:]):
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        want += [(k, *x) for x in own]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(one, key=key) == sorted(many, key=key) == sorted(want, key=key)
    mask = R.random(200) < 0.8
    points = spark.createDataFrame([(None, t, bool(m), "clash") for t, m in enumerate(mask)], "k string, t long, m boolean, a string")
    got = sorted((r.a, r.b) for r in I.mask_to_intervals(points, ["k"], F.col("m"), width).collect())
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))))
    assert got == list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    assert I.merge_intervals(rows.limit(0), ["k"], width).count() == 0
