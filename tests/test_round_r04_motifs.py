"""F5 to F7: sets for one and for growing ranges without a table of pairs, against those from all pairs; the search in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subseqrules.functions import kernels as K
from subseqrules.operators import knn as N

R = np.random.default_rng(23)
WALKS = {
    "walk": R.normal(size=150).cumsum(), "noise": R.normal(size=130).round(1), "again": np.tile(R.normal(size=37), 4), "beside": np.repeat(R.normal(size=40), 4),
    "ties": np.tile([0.0, 2, 1, 3, 5, 2, 0, 1], 9), "flat": np.concatenate((np.zeros(40), R.normal(size=50), np.ones(30))), "tiny": R.normal(size=9), "none": np.zeros(40),
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, 0, t, float(x)) for k, v in WALKS.items() for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, attr_id int, t long, v double").cache()


#: Elsewhere distances and variances are equal but for rounding.
CLEAR = ("walk", "noise", "flat", "tiny", "none")


@pytest.mark.parametrize("m, size", [(8, 16), (7, 64)])
def test_growing_ranges_make_no_pairs(series, m, size, monkeypatch):
    top = 5
    series = series.where(F.col("series_id").isin(*CLEAR))
    pairs = N.subsequence_pairs(series, m, top).cache()
    own = lambda df: {(x.series_id, x.r): x.motif for x in df.collect()}
    want, grown = own(N.range_motif_ranged(pairs, top, m)), own(N.k_motifs_ranged(pairs, top, m))
    monkeypatch.setattr(N, "subsequence_pairs", None)
    assert own(N.range_motif_ranged_of(series, top, m, size=size, few=3 if m == 8 else 1024)) == want and len(want) > 5
    got = own(N.k_motifs_ranged_of(series, top, m, size=size))
    assert got == grown and len(got) > 5


@pytest.mark.parametrize("r", [0.5, 3.0, 7.0])
def test_most_matches(series, r):
    pairs = N.subsequence_pairs(series, 8, r)
    want = {x.series_id: (x.start, x.n, round(x.var, 9)) for x in N.k_motifs(pairs, r, 8).select("series_id", "start", F.size("matches").alias("n"), "var").collect()}
    got = {x.series_id: (x.start, x.n, round(x.var, 9)) for x in N.most_matches(series, 8, [r], size=32).collect()}
    assert {k: x[1:] for k, x in got.items()} == {k: x[1:] for k, x in want.items()} and [got.get(k) for k in CLEAR] == [want.get(k) for k in CLEAR]


def test_pairs_within_a_limit_and_starts_reached(spark, series):
    starts = spark.createDataFrame([("walk", 0, 5), ("walk", 0, 90), ("again", 0, 3)], "series_id string, attr_id int, pos long")
    limits = spark.createDataFrame([("walk", 0, 8, 4.0), ("again", 0, 8, 0.5)], "series_id string, attr_id int, m int, limit double")
    every = [(x.series_id, x.i, x.j, x.dist) for x in N.subsequence_pairs(series, 8, 6.0).collect()]
    bound, asked = {"walk": 4.0, "again": 0.5}, {(x.series_id, x.pos) for x in starts.collect()}
    want = {(s, i, j) for s, i, j, d in every if d <= bound.get(s, 6.0) and ((s, i) in asked or (s, j) in asked)}
    assert {(x.series_id, x.i, x.j) for x in N.pairs_of_starts(series, starts, 8, 6.0, size=32, limits=limits).collect()} == want
    hit = {(s, j) for s, i, j in want if (s, i) in asked} | {(s, i) for s, i, j in want if (s, j) in asked}
    assert {(x.series_id, x.o) for x in N.reached(series, starts, 8, limits, size=32).collect()} == hit and hit


def test_nearest_within_tight_and_wide_bounds(series):
    """Copies give tight bounds, which another search takes: the same neighbours in chunks of all sizes, and with even zones from both ends."""
    for even, lag in ((False, -5), (True, -4)):
        for size in (16, 4096):
            got = {(x.series_id, x.start): (x.nbr, round(x.dist, 6)) for x in N.subsequence_knn(series, 8, 2, size=size, even=even).where("rank = 1").collect()}
            for s in ("walk", "noise", "again"):
                w = K.Windows(WALKS[s], 8)
                d = K.tile_distances(w, np.arange(w.n), w, "znormed_ed").round(6)
                for i in range(w.n):
                    x = np.arange(w.n) - i
                    row = np.where((x <= lag) | (x >= 4), d[i], np.inf)
                    assert got[s, i][1] == pytest.approx(row.min(), abs=2e-6) and row[got[s, i][0]] <= row.min() + 2e-6


@pytest.mark.parametrize("kind", K.DISTANCES)
def test_blocks_hold_all_pairs(kind):
    """Also with rows without a bound and widths that no block divides."""
    v = R.normal(size=1300).cumsum()
    a, b = K.Windows(v[:660], 8), K.Windows(v[300:], 8)
    d = K.tile_distances(a, np.arange(a.n), b, kind)
    bound = np.full(a.n, np.nanquantile(d, 0.02))
    bound[::7], bound[5::11] = -np.inf, np.nanquantile(d, 0.5)
    for block in (64, 512):
        pairs = [np.concatenate(x) for x in zip(*K.near_places(a, b, kind, bound, block=block))]
        got = set(zip(pairs[0].tolist(), pairs[1].tolist()))
        assert len(got) == len(pairs[0])
        edge = np.abs(d - bound[:, None]) < 1e-7
        want = (d <= bound[:, None]) & ~edge
        assert got - set(zip(*map(np.ndarray.tolist, np.nonzero(edge)))) == set(zip(*map(np.ndarray.tolist, np.nonzero(want))))
