import numpy as np
import pytest
from pyspark.sql import functions as F

from subseqrules.config import MiningConfig, preset
from subseqrules.operators import impute as Q
from subseqrules.operators import intervals as I
from subseqrules.operators import knn as N
from subseqrules.operators import motifs as M
from subseqrules.operators import series as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_and_subtract(spark):
    r = np.random.default_rng(5)
    data = [("k" + str(i % 4), int(a), int(a + r.integers(-2, 9))) for i, a in enumerate(r.integers(0, 60, 40))]
    df = spark.createDataFrame(data, "key string, a long, b long")
    for key, a, b in rows(I.merge_intervals(df, ["key"]), "key", "a", "b"):
        assert a < b
    points = lambda xs, k: {t for kk, a, b in xs if kk == k for t in range(a, b)}
    ranges = spark.createDataFrame([(f"k{i}", 5, 50) for i in range(5)], "key string, lo long, hi long")
    merged, free = (rows(x, "key", "a", "b") for x in (I.merge_intervals(df, ["key"]), I.subtract_intervals(ranges, df, ["key"])))
    for i in range(5):
        assert points(merged, f"k{i}") == points(data, f"k{i}")
        assert points(free, f"k{i}") == set(range(5, 50)) - points(data, f"k{i}")
    run = rows(I.longest_free_run(ranges, df, ["key"], 60), "key", "a", "b", "too_short")
    assert run[-1] == ("k4", 5, 50, True)


def test_overlaps_are_found_once(spark):
    r = np.random.default_rng(6)
    x = [(int(i), int(a), int(a + n)) for i, (a, n) in enumerate(zip(r.integers(0, 300, 30), r.integers(1, 90, 30)))]
    y = [(int(i), int(a), int(a + n)) for i, (a, n) in enumerate(zip(r.integers(0, 300, 30), r.integers(1, 90, 30)))]
    left = spark.createDataFrame([("k", *t) for t in x], "key string, pred_id int, a long, b long")
    right = spark.createDataFrame([("k", *t) for t in y], "key string, occ_id int, c long, d long")
    for width in (7, 64, 1000):
        got = rows(I.overlapping(left, right, ["key"], width), "pred_id", "occ_id")
        assert got == sorted((i, j) for i, a, b in x for j, c, d in y if a < d and c < b)


def test_greedy_starts(spark):
    df = spark.createDataFrame([([9, 1, 5, 4, 12, 1],), ([],)], "s array<int>")
    assert [r[0] for r in df.select(I.filter_close_starts(F.col("s"), 4)).collect()] == [[1, 5, 9], []]
    assert [r[0] for r in df.select(I.drop_trivial_matches(F.col("s"), 6)).collect()] == [[1, 5, 9], []]


def test_knn_is_the_same_with_any_blocks(spark):
    v = np.random.default_rng(7).normal(size=120).cumsum()
    data = [(k, 0, i, float(x + j)) for j, k in enumerate("ab") for i, x in enumerate(v)] + [("short", 0, 0, 1.0)]
    packed = S.pack(spark.createDataFrame(data, "series_id string, attr_id int, t long, v double"))
    cols = ("series_id", "start", "rank", "nbr")
    one, many = (rows(N.subsequence_knn(packed, 10, 3, size=c), *cols) for c in (10**6, 37))
    assert one == many and not any(r[0] == "short" for r in one)
    h = 5
    for s, start, rank, nbr in one:
        if rank:
            assert abs(start - nbr) >= h


def test_sliding_windows_of_short_series(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0)], "series_id string, attr_id int, t long, v double")
    assert S.sliding(df, 3).count() == 0
    assert rows(S.sliding(df, 2), "mean", "std", "sumsq", "complexity") == [(2.0, 1.0, 10.0, 4.0)]


def test_sweep_keeps_free_starts(spark):
    df = spark.createDataFrame([("a", t, d, 1.0) for t, d in ((0, 5), (3, 9), (5, 4), (6, 4), (11, 2))], "k string, t1 long, delta int, lam double")
    assert rows(M.sweep(df, ["k"]), "occ_id", "t1") == [(0, 0), (1, 6), (2, 11)]


def test_plan_segment_goes_on_from_what_it_filled():
    v = np.array([1.0, 2.0] + [np.nan] * 6)
    got = Q.plan_segment(2, 8, [(0, 1, 5, 0.1, [0.0, 1.0, 2.0, 3.0]), (1, 4, 8, 0.1, [0.0, 1.0, 1.0, 2.0])], Q.Filled(v))
    assert [(a, b) for a, b, *_ in got][-1][1] == 8 and not np.isnan(v).any()


def test_presets():
    assert preset("IMU").double_step == 40 and preset("unknown") == preset("exchange_rate")


def test_planted_rule_is_found(spark):
    from subseqrules.plans import jobs as J

    t = F.col("id")
    u, h = t % 100, 1 + F.floor(t / 100) % 3
    saw = lambda x, n: F.when((x >= 0) & (x < n), F.when(x < n / 2, x / (n / 2)).otherwise((n - x) / (n / 2))).otherwise(0.0)
    side = lambda k, v: spark.range(1000).select(F.lit("s").alias("series_id"), F.lit(k).alias("attr_id"), t.alias("t"), v.alias("v"))
    series = side(0, saw(u, 40) * h).union(side(1, saw(u - 12, 50) * h * 2))
    cfg = MiningConfig(epsilon_m=0.1, delta_lo=20, delta_hi=60, gamma_penalty=0, k_max=6, max_iter=500, supp=0.6, window_rate=0.05)
    out = J.mine_rules(series, cfg, m=40, max_rounds=1)
    rule = out["rules"].where("lhs[0].attr_id = 0 and rhs.attr_id = 1").first()
    assert rule.supp >= 0.9 and abs(rule.coef_lam[3] - 2) < 1e-6 and abs(rule.coef_t1[1] - 1) < 1e-6
    gap = series.withColumn("v", F.when((F.col("attr_id") != 1) | ~F.col("t").between(320, 349), F.col("v")))
    fixed = J.impute_and_correct(gap, out["rules"], out["occurrences"], out["motif_classes"], truth=series)
    assert fixed["rmse_corrected"].first()[0] < fixed["rmse_baseline"].first()[0]
    broken = (F.col("attr_id") == 1) & F.col("t").between(412, 461)
    test = series.withColumn("v", F.when(broken, 0.0).otherwise(F.col("v")))
    labels = series.groupBy("t").agg(F.max((broken & (F.col("v") > 1.1)).cast("int")).alias("label"))
    baseline = labels.select("t", (F.col("t") == 999).cast("int").alias("y_pred"))
    got = J.detect_anomalies(out["rules"], out["occurrences"], out["motif_classes"], test, labels, epsilon=1.0, rhs_attrs=[1], topk=1, baseline=baseline)
    metrics = got["rule"].first()
    assert metrics.recall > 0.5 and metrics.precision > 0.8  # a forecast is as long as its class's occurrences
    assert got["union"].first().fp == metrics.fp + 1 and got["baseline"].first().tp == 0


def test_files_of_labelled_samples(spark, tmp_path):
    """A headerless CSV, the class first, through reading, mining of rules in each sample and classification."""
    from subseqrules.plans import jobs as J
    from subseqrules.sources import io

    r = np.random.default_rng(9)
    tooth = np.concatenate((np.arange(10.0), np.arange(10.0)[::-1]))
    for name in ("train", "test"):
        lines = []
        for k in range(8):
            v = r.normal(size=140) * 0.01
            for t in range(2, 110, 34):
                v[t : t + 20] += tooth * (1 + r.integers(0, 3))
            lines.append(",".join([str(1 + k % 2), *map(str, (v if k % 2 else -v[::-1]).round(5))]))
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    train, test = (io.read_samples(spark, f"file://{tmp_path}/{n}.csv", header=False, split=n) for n in ("train", "test"))
    assert rows(train.groupBy("label").count(), "label", "count") == [(1.0, 4), (2.0, 4)] and {len(x.vals) for x in test.collect()} == {140}
    cfg = preset("Trace").but(delta_lo=10, delta_hi=30, k_max=4, min_count=2, max_iter=64, supp=0.5, error_kind="mean")
    mined = J.mine_sample_rules(train, cfg)
    assert mined["motif_classes"].count() > 0 and mined["occurrences"].count() >= 2 * mined["motif_classes"].count()
    out = J.boost_classification(mined["rules"], mined["motif_classes"], train, test, cfg, sampling=1.0)
    assert {x.label for x in out["predicted"].collect()} <= {1.0, 2.0} and out["predicted"].count() == 8 and 0 <= out["accuracy"].first()[0] <= 1


@pytest.mark.parametrize("make", ["zscore", "pack", "zero_fill", "clean_univariate", "amplitude"])
def test_empty_tables(spark, make):
    empty = spark.createDataFrame([], "series_id string, attr_id int, t long, v double")
    assert getattr(S, make)(empty).count() == 0
