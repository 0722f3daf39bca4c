"""Findings of round 3 on intervals and greedy picks, against plain definitions."""

import numpy as np
from pyspark.sql import functions as F

from subseqrules.operators import intervals as I


def test_free_parts_take_one_sort_and_hold_no_table(spark):
    rng = np.random.default_rng(11)
    blocked = [(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 30, 200), rng.integers(-20, 120, 200), rng.integers(-2, 25, 200))] + [(None, 3, 9), (1, None, 5), (2, 4, None)]
    ranges = {k: (int(rng.integers(0, 40)), int(rng.integers(30, 100))) for k in range(3, 34)} | {None: (0, 10)}
    b = spark.createDataFrame(blocked, "k long, a long, b long")
    r = spark.createDataFrame([(k, *x) for k, x in ranges.items()] + [(50, None, 9), (51, 1, None)], "k long, lo long, hi long")
    out = I.subtract_intervals(r, b, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "Join" not in plan and "Aggregate" not in plan
    want = set()
    for k, (lo, hi) in ranges.items():
        free = [t for t in range(lo, hi) if k is None or not any(x == k and None not in (x, y, z) and y <= t < z for x, y, z in blocked)]
        for t in free:
            if t - 1 not in free:
                end = t
                while end in free:
                    end += 1
                want.add((k, t, end))
    assert {tuple(x) for x in out.collect()} == want


def test_exits_of_many_chunks_at_once():
    """As chunk by chunk, in a number of numpy calls that does not grow with the chunks."""
    from subseqrules.functions import kernels as K

    rng, width = np.random.default_rng(13), 8
    place = np.sort(rng.integers(-200, 400, 500))
    reach = place + rng.integers(-1, 12, 500)
    c = place // width
    of = np.unique(c, return_inverse=True)[1]
    keep, out, count = K.orbit_exits_of_chunks(of, place - c * width, np.clip(reach - c * width, 0, width), reach, np.full(500, 5), width)
    got = list(zip(c[keep].tolist(), place[keep].tolist(), out.tolist(), count.tolist()))
    want = []
    for x in np.unique(c):
        own = c == x
        want += [(int(x), *map(int, e)) for e in zip(*K.orbit_exits(place[own], reach[own], int(x) * width + 5))]
    assert got == want


def test_greedy_rows_of_small_chunks_stay_rows(spark):
    rng = np.random.default_rng(17)
    rows = [(None if k == 9 else float("nan") if k == 8 else float(k), int(t), int(d), "x") for k, t, d in zip(rng.integers(0, 10, 800), rng.integers(-60, 300, 800), rng.integers(0, 40, 800))]
    df = spark.createDataFrame(rows, "k double, t1 long, delta int, more string")
    want = []
    for k in {str(r[0]) for r in rows}:
        at, place = -(10**9), 0
        for r in sorted((r for r in rows if str(r[0]) == k), key=lambda r: r[1:3]):
            if r[1] >= at:
                want.append((k, r[1], r[2], place))
                at, place = r[1] + r[2] + 1, place + 1
    for width in (1, 64, 1 << 16):
        got = I.greedy_rows(df, ["k"], ["t1", "delta"], F.col("delta") + 1, width)
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((str(r.k), r.t1, r.delta, r.place) for r in got.collect()) == sorted(want) and {r.more for r in got.collect()} == {"x"}
