"""F8: rows that share a start or a place are compared once."""

import numpy as np
from pyspark.sql import functions as F

from subseqrules.operators import intervals as I


def test_companions_of_equal_starts_are_looked_for_once(spark, monkeypatch):
    """As by definition, with ids that have several starts, sides without an occurrence and null ids; the pairs made don't grow with the rows."""
    rng = np.random.default_rng(5)
    first = [(int(k), int(t)) for k, t in zip(rng.integers(0, 400, 500), rng.integers(0, 30, 500))] + [(401, None), (402, 10**6)]
    others = [(int(p), int(i), int(t), int(d)) for i, (p, t, d) in enumerate(zip(rng.integers(1, 3, 600), rng.integers(0, 40, 600), rng.integers(0, 6, 600)))]
    coef = {1: (1.0, 3.0), 2: (0.5, -1.0)}
    made, real = [], I.overlapping
    monkeypatch.setattr(I, "overlapping", lambda *a: made.append(real(*a)) or made[-1])
    f, o = spark.createDataFrame(first, "occ_id long, t1 long"), spark.createDataFrame(others, "pos int, occ_id long, t1 long, delta long")
    c = spark.createDataFrame([(p, *x) for p, x in coef.items()], "pos int, slope double, intercept double")
    got = {r.occ_id: list(r.occs) for r in I.companion_join(f, o, c).collect()}
    length, want = {p: max(d for q, _, _, d in others if q == p) for p in coef}, {}
    for i in {i for i, _ in first}:
        best = []
        for p, (slope, more) in coef.items():
            found = []
            for t in (t for k, t in first if k == i and t is not None):
                a = round(slope * t + more)
                found += [(-(min(a + length[p], s + d) - max(a, s)), x) for q, x, s, d in others if q == p and d > 0 and a < s + d and s < a + length[p]]
            best += [min(found)[1]] if found else []
        if len(best) == len(coef):
            want[i] = [i, *best]
    assert got == want and want
    pairs = made[0].count()
    twice = I.companion_join(f.unionByName(f.withColumn("occ_id", F.col("occ_id") + 1000)), o.unionByName(o.withColumn("occ_id", F.col("occ_id") + 1000)), c)
    assert made[1].count() == pairs and twice.count() == 2 * len(want)
