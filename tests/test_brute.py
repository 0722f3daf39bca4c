"""Operators that SQL can't express, against slow versions written from their definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from subseqrules.functions import kernels as K
from subseqrules.operators import impute as Q
from subseqrules.operators import knn as N
from subseqrules.operators import motifs as M
from subseqrules.operators import pairs as P
from subseqrules.operators import series as S
from subseqrules.operators.rules import predict_rhs

import one_series
from test_kernels import slow_distance

SERIES = "series_id string, attr_id int, t long, v double"
R = np.random.default_rng(31)
WALKS = {k: R.normal(size=n).cumsum() for k, n in (("a", 70), ("b", 55), ("tiny", 9))}
WALKS["ties"] = np.tile([0.0, 2, 1, 3, 5, 2, 0, 1], 7)


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(k, 0, t, float(x)) for k, v in WALKS.items() for t, x in enumerate(v)]
    return S.pack(spark.createDataFrame(rows, SERIES)).cache()


def distances(v, m, kind="znormed_ed"):
    n = len(v) - m + 1
    return np.array([[slow_distance(v[i : i + m], v[j : j + m], kind) for j in range(n)] for i in range(n)]).reshape(max(n, 0), max(n, 0))


def greedy(d, i, k, h):
    """Take the nearest start again and again; what lies in [p - h, p + h) of one taken can't be."""
    taken = [(i, 0.0)]
    free = [j for j in range(len(d)) if not i - h <= j < i + h]
    while len(taken) < k and free:
        p = min(free, key=lambda j: (d[j], j))
        taken.append((p, d[p]))
        free = [j for j in free if not (p - h <= j < max(p + h, p + 1))]
    return taken


@pytest.mark.parametrize("size,long_form", [(4096, False), (13, False), (9, True), (5, False)])
def test_knn(packed, size, long_form):
    m, k, h = 8, 4, 4
    got = {}
    for r in N.subsequence_knn(S.unpack(packed) if long_form else packed, m, k, size=size).collect():
        got.setdefault((r.series_id, r.start), []).append((r["rank"], r.nbr, r.dist))
    for s in ("a", "b"):
        d = distances(WALKS[s], m)
        for i in range(len(d)):
            own = sorted(got.pop((s, i)))
            want = greedy(d[i], i, k, h)
            assert [x[1] for x in own] == [p for p, _ in want] and np.allclose([x[2] for x in own], [x for _, x in want], atol=1e-6)
    assert {s for s, _ in got} == {"tiny", "ties"}


def test_order_by_kth_distance(packed):
    near = N.subsequence_knn(packed, 8, 3)
    want = {}
    for r in near.collect():
        if r["rank"] == 2:
            want.setdefault(r.series_id, []).append((r.dist, r.start))
    for bound in (None, 6.0):
        got = {}
        for r in N.order_by_kth_distance(near, 3, bound).collect():
            got.setdefault(r.series_id, []).append((r.place, r.start))
        for s, rows in want.items():
            assert [x for _, x in sorted(got.get(s, []))] == [x for d, x in sorted(rows) if bound is None or d < bound]


def kept(starts, m):
    out = []
    for s in sorted(starts):
        if not out or s > out[-1] + m / 2:
            out.append(s)
    return out


def zoned(v, m):
    d, h = distances(v, m), m // 2
    for i in range(len(d)):
        for j in range(len(d)):
            if abs(i - j) < h:
                d[i, j] = np.inf
    return d


def slow_range(d, r, m):
    least = d.min()
    pair = sorted({int(i) for ij in np.argwhere(d == least) for i in ij})
    return kept({*pair, *[int(j) for p in pair for j in np.flatnonzero(d[p] <= r - least)]}, m), pair


@pytest.mark.parametrize("r", [6.0, 1.0, 9.0])
def test_range_motif(packed, r):
    m = 8
    every = N.subsequence_pairs(packed, m, float("inf"))
    cut = N.subsequence_pairs(packed, m, r)
    for pairs, closest in ((every, None), (cut, N.pair_motif(every))):
        got = {x.series_id: (x.motif, x.dist) for x in N.range_motif(pairs, r, m, closest).collect()}
        for s in ("a", "b"):
            d = zoned(WALKS[s], m)
            assert got[s][0] == slow_range(d, r, m)[0] and abs(got[s][1] - d.min()) < 1e-6


@pytest.mark.parametrize("r", [4.0, 7.0, 10.0])
def test_k_motifs(packed, r):
    m = 8
    got = {x.series_id: (x.start, x.matches) for x in N.k_motifs(N.subsequence_pairs(packed, m, r), r, m).collect()}
    for s in ("a", "b", "ties"):
        d = zoned(WALKS[s], m)
        np.fill_diagonal(d, 0)
        most, spread, best = -1, -1.0, None
        for i, row in enumerate(d.round(9)):
            near = np.flatnonzero(row <= r)
            if len(near) > most:
                own = kept(near.tolist(), m)
                var = round(float(np.var(row[own])), 9)
                if len(own) > most or (var < spread and len(own) == most):
                    most, spread, best = len(own), var, (i, own)
        if (np.where(np.eye(len(d)) > 0, np.inf, d) <= r).any():
            assert got[s][1] == best[1], s


def test_ranged_sets(packed):
    m, top = 8, 8
    pairs = N.subsequence_pairs(packed, m, float("inf"))
    got, grown = {}, {}
    for x in N.range_motif_ranged(pairs, top, m).collect():
        got.setdefault(x.series_id, []).append((x.r, x.motif))
    for x in N.k_motifs_ranged(pairs, top, m).collect():
        grown.setdefault(x.series_id, []).append((x.r, len(x.motif)))
    for s in ("a", "b"):
        d, size = zoned(WALKS[s], m), 2
        want = [(0.0, slow_range(d, 0, m)[1])]
        for r in range(1, top + 1):
            own, _ = slow_range(d, r, m)
            if len(own) > size:
                want.append((float(r), own))
                for p in own:
                    d[:, max(0, p - m // 2) : p + m // 2] = np.inf
                size = len(own)
        assert sorted(got[s]) == want
        sizes = [n for _, n in sorted(grown[s])]
        assert sizes[0] == 2 and all(a < b for a, b in zip(sizes, sizes[1:]))


def test_k_motiflets(packed):
    m, k_max = 8, 5
    near = N.subsequence_knn(packed, m, k_max)
    lists = {}
    for r in sorted(near.collect(), key=lambda r: r["rank"]):
        lists.setdefault((r.series_id, r.start), []).append(r.nbr)
    for first in (2048, 7, 1):
        got = {(r.series_id, r.k): (r.extent, sorted(r.members)) for r in M.k_motiflets(packed, near, k_max, first=first).collect()}
        for s in ("a", "b"):
            d = distances(WALKS[s], m)
            for k in range(2, k_max):
                best = min(max(d[i][j] for i, j in itertools.combinations(x[:k], 2)) for (q, _), x in lists.items() if q == s and len(x) >= k)
                assert abs(got[s, k][0] - best) < 1e-6 and len(got[s, k][1]) == k
                assert abs(max(d[i][j] for i, j in itertools.combinations(got[s, k][1], 2)) - best) < 1e-6


@pytest.mark.parametrize("size,long_form", [(4096, True), (13, False), (5, True), (2, False)])
def test_similarity(packed, size, long_form):
    radius, least = 3, 0.45
    got = {(r.series_id, r.i, r.j): r.similarity for r in N.similarity_pairs(S.unpack(packed) if long_form else packed, radius, least, skip=[(10, 20)], size=size).collect()}
    want = {}
    for s, v in WALKS.items():
        w = []
        for i in range(len(v)):
            x = v[max(0, i - radius) : i + radius + 1]
            spread = x.max() - x.min()
            w.append((x - x[0]) / spread if spread else x * 0)
        for i, j in itertools.combinations(range(len(v)), 2):
            if not (10 <= i < 20 or 10 <= j < 20):
                n = min(len(w[i]), len(w[j]))
                x = 1 / (1 + np.sqrt(((w[i][:n] - w[j][:n]) ** 2).sum()))
                if x >= least + 1e-9:
                    want[s, i, j] = x
                elif abs(x - least) < 1e-9:
                    got.pop((s, i, j), None)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fits(spark):
    x = R.normal(size=(60, 2))
    y = np.stack((2 + x @ [1.5, -3], x @ [0.5, 0.25] - 1), axis=1) + R.normal(size=(60, 2)) * 0.1
    rows = [(int(i % 3), *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(x, y))] + [(9, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g int, f1 double, f2 double, y1 double, y2 double")
    for r in P.multi_output_lstsq(df, ["g"], ["f1", "f2"], ["y1", "y2"]).collect():
        own = np.array([q[1:] for q in rows if q[0] == r.g])
        a = np.column_stack((np.ones(len(own)), own[:, :2]))
        want = np.linalg.pinv(a.T @ a) @ a.T @ own[:, 2:]  # normal equations; of minimum norm for the group of one row
        assert np.allclose(np.array(r.coef), want.T, atol=1e-6)
    for r in P.poly_fit(df, ["g"], 2, y="y1", x="f1").where("g < 9").collect():
        own = np.array([q[1:] for q in rows if q[0] == r.g])
        assert np.allclose(r.coef, np.polyfit(own[:, 0], own[:, 2], 2)[::-1])


def test_piecewise_fit_is_the_best_cut():
    n, segments = 11, 3
    x, y = np.linspace(0, 1, n), R.normal(size=n)
    slope = np.array([np.polyfit(x[max(0, i - 5) : i + 5], y[max(0, i - 5) : i + 5], 1)[0] for i in range(n)])
    f = np.stack((x, y, slope), axis=1)
    f = (f - f.mean(axis=0)) / f.std(axis=0)
    spread = lambda a, b: ((f[a:b] - f[a:b].mean(axis=0)) ** 2).sum()
    best = min(((sum(spread(a, b) for a, b in zip((0, *c), (*c, n))), c) for c in itertools.combinations(range(1, n), segments - 1)))[1]
    breaks, slopes, intercepts = K.piecewise_fit(x, y, segments)
    assert np.allclose(breaks, [x[0], *x[list(best)], x[-1]])
    for (a, b), s, c in zip(zip((0, *best), (*best, n)), slopes, intercepts):
        if b - a > 1:
            assert np.allclose((s, c), np.polyfit(x[a:b], y[a:b], 1))


def slow_elbows(d, alpha=2.0, deviation=1.0):
    ratio = {}
    for k in range(3, len(d) - 1):
        if all(np.isfinite(d[k - 1 : k + 2])) and d[k] > 0 and d[k + 1] > deviation * d[k]:
            ratio[k] = (d[k + 1] - d[k] + 1e-5) / (d[k] - d[k - 1] + 1e-5)
    out = []
    while ratio and max(ratio.values()) > alpha:
        k = min(ratio, key=lambda q: (-ratio[q], q))
        out.append(k)
        for q in (k - 1, k, k + 1):
            ratio.pop(q, None)
    return sorted(out) or [2]


def test_elbows():
    for _ in range(200):
        d = np.sort(R.exponential(size=R.integers(1, 14))).cumsum()
        d[R.integers(0, len(d)) :] += R.choice([0, 5])
        if R.random() < 0.2:
            d[-1] = np.inf
        assert K.elbow_points(d) == slow_elbows(d)


def test_trim_flat_ends():
    for _ in range(200):
        n = int(R.integers(6, 40))
        v = np.concatenate((np.zeros(R.integers(0, 15)), R.normal(size=n).cumsum() * R.choice([0.1, 3]), np.full(R.integers(0, 15), 2.0)))
        a, b = K.trim_flat_ends(v, 0.5, 5)
        assert 0 <= a < b <= len(v) and (b - a >= min(5, len(v)))
        if (a, b) != (0, len(v)):  # what is cut beyond the point kept is flat
            assert a == 0 or np.ptp(v[:a]) < 0.5
            assert b == len(v) or np.ptp(v[b:]) < 0.5 if len(v[b:]) else True
    flat = np.concatenate((np.zeros(12), np.arange(1.0, 9), np.full(12, 8.0)))
    a, b = K.trim_flat_ends(flat, 0.5, 5)
    assert np.ptp(flat[a:b]) == 8


def test_gap_fill(spark):
    y = np.sin(np.arange(400) / 7) + 0.05 * np.cos(np.arange(400.0) * 3)
    gaps = [(3, 6), (100, 104), (120, 130), (151, 153), (160, 163), (390, 400)]
    given = y.copy()
    for a, b in gaps:
        given[a:b] = np.nan
    got = K.fill_gaps(given, max_obs=60)
    known = ~np.isnan(given)
    assert np.allclose(got[known], y[known]) and np.allclose(got[3:6], given[known].mean())  # three values in reach
    fit, at = None, None
    for a, b in gaps[1:]:
        if fit is None or a - at > 50:
            fit, at = K.Arma(given[max(0, a - 60) : a][known[max(0, a - 60) : a]]), a
        assert np.allclose(got[a:b], fit.forecast(b - a)), a
    assert np.allclose(got[120:124], got[100:104]) and not np.allclose(got[151:153], got[100:102])  # asked again; fitted anew
    assert np.abs(got[390:] - y[390:]).max() < 1.5 and K.fill_gaps(np.array([np.nan, np.nan])).tolist() == [0, 0]
    rows = [("s", 0, t, None if np.isnan(x) else float(x)) for t, x in enumerate(given)]
    filled = S.unpack(Q.baseline_gap_fill(S.pack(spark.createDataFrame(rows, SERIES)), 60)).orderBy("t").collect()
    assert np.allclose([r.v for r in filled], got)


def test_arma_is_least_squares():
    y = R.normal(size=200)
    for t in range(1, 200):
        y[t] += 0.7 * y[t - 1]
    f = K.Arma(y)
    assert 0.5 < f.phi < 0.9 and np.allclose(f.forecast(3)[1:] - y.mean(), f.phi * (f.forecast(3)[:-1] - y.mean()))


def test_predict_rhs(spark):
    occ = [("s", a, c, o, int(t), int(d), float(x)) for a, c in ((0, 0), (1, 0)) for o, (t, d, x) in enumerate(zip(R.integers(0, 90, 6), R.integers(3, 9, 6), R.normal(size=6)))]
    combos = [[0, 2], [1, 1], [5, 3], [4, 0], [2, 9]]
    coef = {k: R.normal(size=7).round(2).tolist() for k in ("t1", "delta", "lam")}
    coef["delta"][0] += 6
    side = "struct<attr_id: int, class_id: int>"
    rules = spark.createDataFrame(
        [("s", 7, [(0, 0), (1, 0)], (0, 1), coef["t1"], coef["delta"], coef["lam"], combos, 0.1, 0.5)],
        f"series_id string, rule_id long, lhs array<{side}>, rhs {side}, coef_t1 array<double>, coef_delta array<double>, coef_lam array<double>, lhs_combinations array<array<int>>, avg_err double, epsilon double")
    o = spark.createDataFrame(occ, "series_id string, attr_id int, class_id int, occ_id int, t1 long, delta int, lam double")
    sizes = spark.createDataFrame([("s", 0, 100)], "series_id string, attr_id int, n long")
    got = sorted((r.combo_id, r.t2, r.delta2, round(r.lam2, 6)) for r in predict_rhs(rules, o, spark.range(0), sizes).collect())
    at, want = {(a, i): x for _, a, _, i, *x in occ}, []
    for c, combo in enumerate(combos):
        if all((k, i) in at for k, i in enumerate(combo)):
            x = [1.0, *[float(v) for k, i in enumerate(combo) for v in at[k, i]]]
            t, d, lam = (float(np.dot(coef[k], x)) for k in ("t1", "delta", "lam"))
            if round(t) >= 0 and round(d) > 0 and round(t) + round(d) <= 100:
                want.append((c, round(t), round(d), round(lam, 6)))
    assert got == want


@pytest.mark.parametrize("f", [lambda d: N.subsequence_knn(d, 4, 3), lambda d: N.subsequence_pairs(d, 4, 9.0), lambda d: N.similarity_pairs(d, 2, 0.5), lambda d: M.k_motiflets(d, N.subsequence_knn(d, 4, 3), 3)])
def test_empty_series(spark, f):
    assert f(S.pack(spark.createDataFrame([], SERIES))).count() == 0


@pytest.mark.parametrize("size", [7, 20, 64])
def test_pairs_of_tiles(packed, size):
    key = lambda r: (r.series_id, r.i, r.j)
    whole = {key(r): r.dist for r in N.subsequence_pairs(packed, 8, 9.0, step=3).collect()}
    for rows in (packed, S.unpack(packed)):
        got = {key(r): r.dist for r in N.subsequence_pairs(rows, 8, 9.0, step=3, size=size).collect()}
        assert got.keys() == whole.keys() and np.allclose([got[k] for k in whole], list(whole.values()), atol=1e-6)


@pytest.mark.parametrize("before,after", [(0, 0), (3, 5), (0, 17), (9, 2)])
def test_chunks(packed, before, after):
    for rows in (packed, S.unpack(packed)):
        got = {(r.series_id, r.c): (r.lo, list(r.part)) for r in S.chunks(rows, 8, before=before, after=after).collect()}
        want = {(s, c): (8 * c, v[max(0, 8 * c - before) : 8 * c + 8 + after].tolist()) for s, v in WALKS.items() for c in range(-(-len(v) // 8))}
        assert got == want


def test_no_row_holds_a_series(spark):
    rows = spark.range(5000).select(F.lit("s").alias("series_id"), F.lit(0).alias("attr_id"), F.col("id").alias("t"), F.sin("id").alias("v"))
    assert N.strips(rows, [16], size=100).agg(F.max(F.size("part"))).first()[0] == 115


def test_chain_in_spark(spark):
    rows = [(int(i % 3), int(a), int(b), i) for i, (a, b) in enumerate(R.integers(0, 9, (30, 2)))]
    got = {}
    for r in P.ordered_chain(spark.createDataFrame(rows, "key int, a long, b long, id int"), ["key"], ["a", "b"], "a").orderBy(F.col("a")).collect():
        got.setdefault(r.key, []).append((r.a, r.b))
    for k in range(3):
        own = [(a, b) for g, a, b, _ in rows if g == k]
        best = max(n for n in range(1, 8) for c in itertools.combinations(sorted(set(own)), n) if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:])))
        assert len(got[k]) == best and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got[k], got[k][1:]))


def test_two_sided_rule_is_mined(spark):
    """The right height is the sum of two left ones that vary on their own: no one-sided rule holds, the widened one does."""
    from subseqrules.config import MiningConfig
    from subseqrules.operators.rules import mine_valid_rules

    n = 16
    a, b = R.permutation(np.repeat([1.0, 2, 4, 8], 4)), R.permutation(np.repeat([1.0, 2, 4, 8], 4))
    sides = {0: (0, 20, a), 1: (10, 20, b), 2: (40, 30, a + b)}  # attr: (start in the period, length, heights)
    v = {k: np.zeros(100 * n + 50) for k in sides}
    occ = []
    for k, (start, size, lam) in sides.items():
        x = np.arange(size) / (size - 1)
        shape = np.where(x < 0.5, 2 * x, 2 - 2 * x)
        for i in range(n):
            v[k][100 * i + start : 100 * i + start + size] = shape * lam[i]
            occ.append(("s", k, 0, i, 100 * i + start, size, float(lam[i])))
    o = spark.createDataFrame(occ, "series_id string, attr_id int, class_id int, occ_id int, t1 long, delta int, lam double")
    classes = spark.createDataFrame([("s", k, 0, [0.0, 0.5, 1.0], [2.0, -2.0], [0.0, 2.0]) for k in sides], "series_id string, attr_id int, class_id int, breaks array<double>, slopes array<double>, intercepts array<double>")
    packed = spark.createDataFrame([("s", k, len(x), x.tolist()) for k, x in v.items()], "series_id string, attr_id int, n long, vals array<double>")
    cfg = MiningConfig(epsilon_rate=0.3, supp=0.9, max_iter=3000, window_rate=0.05, error_kind="max", max_lhs_len=2)
    pairs = P.match_all_pairs(o, classes, packed, cfg.but(supp=0.3))
    rules = {(tuple(x.attr_id for x in r.lhs), r.rhs.attr_id): r for r in mine_valid_rules(pairs, o, classes, packed, cfg).collect()}
    assert ((0,), 2) not in rules and ((1,), 2) not in rules and ((0, 1), 2) in rules
    r = rules[(0, 1), 2]
    assert r.supp > 0.95 and np.allclose([r.coef_lam[3], r.coef_lam[6]], [1, 1], atol=1e-6) and len(r.lhs_combinations) >= 15
    assert all(c[0] == c[1] for c in r.lhs_combinations)
    narrow = mine_valid_rules(pairs, o, classes, packed, cfg.but(max_lhs_len=1)).collect()
    assert all(len(x.lhs) == 1 for x in narrow)


def test_rounds_of_each_series(spark):
    """The rounds over all series give what all rounds of each series alone give."""
    from subseqrules.config import MiningConfig

    rows = [(k, R.normal(size=40).cumsum().tolist()) for k in range(4)] + [(7, np.tile([0.0, 1, 3, 1, 0, -1], 7).tolist()), (8, [1.0, 2.0]), (9, [])]
    df = spark.createDataFrame(rows, "sample_id long, vals array<double>")
    cfg = MiningConfig(epsilon_m=0.5, delta_lo=5, delta_hi=10, length_step=2, gamma_penalty=0.0, k_max=5, error_kind="mean", min_count=2, n_segments=4)
    for m in (None, 6):
        classes, occ = M.discover_motifs_per_sample(df, cfg, short=0, m=m)
        got = sorted((r.series_id, r.class_id, r.occ_id, r.t1, r.delta, round(r.lam, 6)) for r in occ.collect())
        shapes = {(r.series_id, r.class_id): (round(r.epsilon, 6), r.delta_lo, r.delta_hi, np.round(r.breaks, 6).tolist()) for r in classes.collect()}
        want, kept = [], {}
        for i, v in rows:
            rounds = [x for x in one_series.all_rounds(np.array(v), cfg, m) if len(x[1]) >= cfg.min_count] if v else []
            for c, (row, found) in enumerate(rounds):
                kept[str(i), c] = (round(row["epsilon"], 6), row["delta_lo"], row["delta_hi"], np.round(row["breaks"], 6).tolist())
                want += [(str(i), c, k, t, d, round(x, 6)) for k, (t, d, x) in enumerate(found)]
        assert got == sorted(want) and shapes == kept and len(got) > 5


def slow_matches(v, free, shape, cfg, row):
    """For each free start the longest length, in steps from the longest, whose scaled values follow the shape; then an ascending sweep."""
    out = []
    for s in free:
        for delta in range(row["delta_hi"], row["delta_lo"] - 1, -cfg.double_step):
            if s + delta > len(v):
                continue
            own = v[s : s + delta]
            lam = own.max() - own.min()
            if lam < row["lam_min_bound"] or lam <= 0:
                continue
            t = K.piecewise_predict(np.linspace(0, 1, delta), *shape)
            t = t / (t.max() - t.min()) if t.max() > t.min() else t * 0
            x, w = (own - own[0]) / lam, int(cfg.window_rate * delta)
            e = [max(min(abs(x[i] - t[j]) for j in range(max(0, i - w), min(delta, i + w + 1))), min(abs(t[i] - x[j]) for j in range(max(0, i - w), min(delta, i + w + 1)))) for i in range(delta)]
            e = max(e) if cfg.error_kind == "max" else sum(e) / delta
            if cfg.gamma_penalty:
                q = lam / delta / row["gamma"]
                e *= max(q, 1 / q) ** cfg.gamma_penalty
            if e <= row["epsilon"]:
                out.append((s, delta, round(float(lam), 6)))
                break
    kept_ = []
    for s, d, x in sorted(out):
        if not kept_ or s >= kept_[-1][0] + int(kept_[-1][1] * cfg.minimum_interval) + 1:
            kept_.append((s, d, x))
    return kept_


@pytest.mark.parametrize("kind, gamma, step", [("max", 0.0, 1), ("mean", 0.0, 3), ("max", -0.5, 2)])
def test_scan_occurrences(spark, kind, gamma, step):
    from subseqrules.config import MiningConfig

    shape = ([0.0, 0.5, 1.0], [2.0, -2.0], [0.0, 2.0])
    tooth = np.concatenate((np.arange(8.0), np.arange(8.0)[::-1]))
    v = np.concatenate([np.concatenate((tooth * (1 + i % 3), np.zeros(3 + i))) for i in range(6)]) + R.normal(size=sum(19 + i for i in range(6))) * 0.3
    cfg = MiningConfig(error_kind=kind, gamma_penalty=gamma, double_step=step, window_rate=0.1)
    row = {"epsilon": 0.15 if kind == "max" else 0.08, "lam_min_bound": 2.0, "delta_lo": 12, "delta_hi": 20, "gamma": 0.5}
    packed = S.pack(spark.createDataFrame([("s", 0, t, float(x)) for t, x in enumerate(v)], SERIES))
    classes = spark.createDataFrame([("s", 0, 0, *shape, row["epsilon"], row["lam_min_bound"], row["delta_lo"], row["delta_hi"], row["gamma"])], "series_id string, attr_id int, class_id int, breaks array<double>, slopes array<double>, intercepts array<double>, epsilon double, lam_min_bound double, delta_lo int, delta_hi int, gamma double")
    taken = [(20, 31), (60, 61)]
    forbidden = spark.createDataFrame([("s", 0, a, b) for a, b in taken], "series_id string, attr_id int, a long, b long")
    free = [t for t in range(len(v)) if not any(a <= t < b for a, b in taken)]
    want = slow_matches(v, free, shape, cfg, row)
    assert want
    for chunk in (4096, 30):
        got = sorted((r.t1, r.delta, round(r.lam, 6)) for r in M.scan_occurrences(packed, classes, forbidden, cfg, chunk).collect())
        assert got == want


def test_rule_regions_and_score(spark):
    from subseqrules.config import MiningConfig
    from subseqrules.operators import classify as C

    shape = ([0.0, 0.5, 1.0], [2.0, -2.0], [0.0, 2.0])
    tooth = lambda n: np.array([2 * x if x < 0.5 else 2 - 2 * x for x in np.arange(n) / (n - 1)])
    left, right = np.zeros(200), np.zeros(200)
    for k, (t, h) in enumerate([(5, 3.0), (50, 2.0), (100, 4.0), (150, 5.0)]):
        left[t : t + 15] = tooth(15) * h
        right[t + 20 : t + 35] = tooth(15) * h * 2 if k != 2 else np.arange(15) % 5
    cfg = MiningConfig(error_kind="max", gamma_penalty=0.0, window_rate=0.1)
    row = {"epsilon": 0.05, "lam_min_bound": 1.0, "delta_lo": 15, "delta_hi": 15, "gamma": 1.0}
    rules = spark.createDataFrame(
        [("x", 1, [(0, 0)], left.tolist(), right.tolist(), *shape, *shape, 0.05, 1.0, 15, 15, 1.0, [20.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 2.0], 0.3), ("none", 1, [(0, 0)], [0.0] * 40, right.tolist(), *shape, *shape, 0.05, 1.0, 15, 15, 1.0, [20.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 2.0], 0.3)],
        "key string, rule_id long, lhs array<struct<attr_id: int, class_id: int>>, left_vals array<double>, right_vals array<double>, breaks array<double>, slopes array<double>, intercepts array<double>, "
        "l_breaks array<double>, l_slopes array<double>, l_intercepts array<double>, l_epsilon double, l_bound double, l_lo int, l_hi int, l_gamma double, coef_t1 array<double>, coef_delta array<double>, coef_lam array<double>, epsilon double")
    got = {r.key: r for r in C.rule_score(C.check_rule_regions(rules, cfg, ["key"])).collect()}
    found = slow_matches(left, range(200), shape, cfg, row)
    cover, seen, bad = set(), set(), set()
    for t, d, lam in found:
        cover |= set(range(t, t + d))
        if t + 20 + d > 200:
            continue
        actual, base = right[t + 20 : t + 20 + d], right[t + 20]
        p = K.piecewise_predict(np.arange(d) / (d - 1), *shape) * 2 * lam + base
        e = K.align_error_norm(p, actual, int(d * 0.1))
        seen |= set(range(t + 20, t + 20 + d))
        bad |= {t + 20 + i for i in range(d) if e[i] > 0.3}
    points = lambda xs: {t for x in xs for t in range(x.a, x.b)}
    r = got["x"]
    assert len(found) == 4 and bad and r.lhs_points == len(cover) and points(r.violation) == bad and points(r.satisfaction) == seen - bad and points(r.irrelevant) == set(range(200)) - seen
    assert abs(r.score - (len(cover) / 200 - len(bad) / 200)) < 1e-12 and got["none"].score == 0
