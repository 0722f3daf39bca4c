"""Closest sets from neighbours within a limit only: the same as from those of all starts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subseqrules.functions import kernels as K
from subseqrules.operators import knn as N
from subseqrules.operators import motifs as M


def series():
    r = np.random.default_rng(8)
    x = r.exponential(50, 900)
    return {"fresh": x, "again": np.tile(x[:130], 7), "stairs": np.repeat(x[:60], 17), "short": x[:40], "flat": np.full(600, 7.0), "mixed": np.concatenate((x[:300], np.full(200, 3.0), -x[:300]))}


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(name, 0, v.tolist(), len(v)) for name, v in series().items()]
    return spark.createDataFrame(rows, "series_id string, attr_id int, vals array<double>, n int")


@pytest.mark.parametrize("lengths, k_max", [([12], 6), ([8, 16], 5), ([10], 2)])
def test_sets_are_those_of_all_neighbours(packed, lengths, k_max):
    kept = lambda sets: sorted((r.series_id, r.m, r.k, r.extent, r.kth_dist, r.start, *r.members) for r in sets.collect())
    want = kept(M.k_motiflets(packed, N.subsequence_knn(packed, lengths, k_max), k_max))
    assert kept(M.closest_sets(packed, lengths, k_max, size=128, sight=64)) == want and want


def test_few_neighbours_are_looked_for(packed):
    """All starts had their lists before."""
    limits = packed.select("series_id", "attr_id", F.lit(12).alias("m"), F.lit(2.0).alias("limit")).where("series_id = 'fresh'")
    fresh = packed.where("series_id = 'fresh'")
    every = {(r.start, r["rank"]): (r.nbr, r.dist) for r in N.subsequence_knn(fresh, 12, 5).collect()}
    near = {(r.start, r["rank"]): (r.nbr, r.dist) for r in N.subsequence_knn(fresh, 12, 5, size=128, limits=limits).collect()}
    starts = {s for (s, n), (_, d) in every.items() if n == 1 and d <= 2}
    assert {k: p for k, (p, d) in near.items()} == {k: p for k, (p, d) in every.items() if d <= 2 and k[0] in starts}
    assert 0 < len(near) < len(every) / 2


@pytest.mark.parametrize("scale, level", [(50, 0), (1, 1e4), (1e-6, 0), (1, 1e5)])
@pytest.mark.parametrize("bound", [1e-6, 0.5, 3.0])
def test_no_pair_is_missed_by_its_peaks(scale, level, bound):
    r = np.random.default_rng(5)
    x, y = level + scale * r.exponential(1, 900), level + scale * r.exponential(1, 900)
    y[100:400] = x[200:500]
    y[500:540] = level
    a, b = K.Windows(x, 10), K.Windows(y, 10)
    bounds = np.full(a.n, bound)
    bounds[::3] /= 2
    pairs = lambda found: sorted((i, j, d) for x, y, z in found for i, j, d in zip(x.tolist(), y.tolist(), z.tolist()))
    assert pairs(K.near_shapes(a, b, bounds)) == pairs(K.near_places(a, b, "znormed_ed", np.where(a.flat, -np.inf, bounds)))
