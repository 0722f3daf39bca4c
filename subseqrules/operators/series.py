"""Projections, sampling and sliding windows of `series` (series_id, attr_id, t, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["series_id", "attr_id"]


CHUNK = 1 << 16


def by_key(df: DataFrame, *order: str):
    return Window.partitionBy(*[c for c in KEYS if c in df.columns]).orderBy(*(order or ("t",)))


def whole(df: DataFrame):
    return Window.partitionBy(*[c for c in KEYS if c in df.columns])


def slice_rows(series: DataFrame, lo: int, hi: int) -> DataFrame:
    return series.where((F.col("t") >= lo) & (F.col("t") < hi)).withColumn("t", F.col("t") - lo)


def select_attributes(series: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    """Attributes lo to hi - 1, or all from lo."""
    keep = F.col("attr_id") >= lo
    return series.where(keep if hi is None else keep & (F.col("attr_id") < hi))


def clean_univariate(series: DataFrame) -> DataFrame:
    """Without NaN and NULL, renumbered."""
    rows = series.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.withColumn("t", F.row_number().over(by_key(rows)).cast("long") - 1)


def zero_fill(series: DataFrame) -> DataFrame:
    v = F.col("v")
    return series.withColumn("v", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def stride(series: DataFrame, factor: int) -> DataFrame:
    return series.where(F.col("t") % factor == 0).withColumn("t", F.floor(F.col("t") / factor))


def with_statistics(rows: DataFrame, **stats: Column) -> DataFrame:
    """rows with aggregates of their series beside them. Series of more than a thousandth of all rows, a thousand of them at most, are
    broadcast and so stay where they are; the others meet their statistics by sort and merge. No task holds a whole long series."""
    keys = [c for c in KEYS if c in rows.columns]
    table = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.count("*").alias("_n"), *[v.alias(k) for k, v in stats.items()])
    all_rows = table.agg((F.sum("_n") / 1000).alias("_most"))  # one row
    table = table.join(F.broadcast(all_rows), F.lit(True))
    hot, cold = F.broadcast(table.where("_n > _most")), table.where("_n <= _most")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    names = [*rows.columns, *stats]
    return rows.join(hot, same).select(names).unionByName(rows.join(hot, same, "left_anti").join(cold.hint("merge"), same).select(names))


def downsample_to(series: DataFrame, target_n: int) -> DataFrame:
    """Every i-th point, i = n // target_n where n is over it."""
    rows = with_statistics(series, _f=F.greatest(F.lit(1), F.floor(F.count("*") / target_n)))
    return rows.where(F.col("t") % F.col("_f") == 0).withColumn("t", F.floor(F.col("t") / F.col("_f"))).drop("_f")


def zscore(series: DataFrame) -> DataFrame:
    """Population z-score of each series; flat ones become 0."""
    rows = with_statistics(series, _mean=F.avg("v"), _sd=F.stddev_pop("v"))
    return rows.withColumn("v", F.when(F.col("_sd") == 0, 0.0).otherwise((F.col("v") - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def paa(series: DataFrame, size: int) -> DataFrame:
    """(keys, segment, mean, n): the mean of each run of `size` points; the last may be short."""
    keys = [c for c in KEYS if c in series.columns]
    return series.groupBy(*keys, F.floor(F.col("t") / size).alias("segment")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def sliding(series: DataFrame, m: int, chunk: int = CHUNK) -> DataFrame:
    """For each full window of m points from t: mean, std (under 1e-4: 0.1), sumsq and complexity (sum of squared steps). t rises by
    one from point to point; a run of `chunk` windows with its m - 1 points behind is a partition, so one series is many tasks."""
    keys = [c for c in KEYS if c in series.columns]
    here = F.floor(F.col("t") / chunk)
    rows = series.withColumn("_c", F.explode(F.sequence(F.floor((F.col("t") - (m - 1)) / chunk), here)))
    w = Window.partitionBy(*keys, "_c").orderBy("t")
    full, inner = w.rowsBetween(0, m - 1), w.rowsBetween(0, max(0, m - 2))
    rows = rows.withColumn("_step", F.lead("v").over(w) - F.col("v"))
    sd = F.stddev_pop("v").over(full)
    rows = rows.select(
        *keys, "t", "_c", F.count("*").over(full).alias("_n"), F.avg("v").over(full).alias("mean"),
        F.when(sd < 1e-4, 0.1).otherwise(sd).alias("std"), F.sum(F.col("v") * F.col("v")).over(full).alias("sumsq"),
        (F.sum(F.col("_step") ** 2).over(inner) if m > 1 else F.lit(0.0)).alias("complexity"))
    return rows.where((F.col("_n") == m) & (F.col("_c") == here)).drop("_n", "_c")


def amplitude(series: DataFrame) -> DataFrame:
    return series.groupBy(*[c for c in KEYS if c in series.columns]).agg((F.max("v") - F.min("v")).alias("lam"))


def clip_percentile(series: DataFrame, p: float) -> DataFrame:
    """Values capped at their series' p quantile."""
    rows = with_statistics(series, _top=F.percentile("v", F.lit(p)))
    return rows.withColumn("v", F.least("v", "_top")).drop("_top")


def clip_two_sided(series: DataFrame, r: float) -> DataFrame:
    """Values held between the quantiles r and 1 - r."""
    rows = with_statistics(series, _low=F.percentile("v", F.lit(r)), _top=F.percentile("v", F.lit(1 - r)))
    return rows.withColumn("v", F.greatest(F.least("v", "_top"), "_low")).drop("_low", "_top")


def pack(series: DataFrame) -> DataFrame:
    """One row for each series with its values in order of t."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"])
    return series.groupBy(*KEYS).agg(F.count("*").alias("n"), packed.alias("vals"))


def chunks(series: DataFrame, size: int, *, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, c, lo, part): the values [c * size - before, (c + 1) * size + after) of each series, cut at its ends, in order; lo is c * size.
    series is packed, or has a row for each value with t from 0 without gaps: then a value goes to the chunk it lies in and to
    those whose halo it is in, and no row ever holds a whole series."""
    if "vals" in series.columns:
        cut = lambda c: F.struct(c.alias("c"), (c * size).alias("lo"), F.slice("vals", F.greatest(c * size - before, F.lit(0)) + 1, F.lit(size + after) + F.least(c * size, F.lit(before))).alias("part"))
        some = series.where(F.size("vals") > 0).withColumn("_last", F.floor((F.size("vals") - 1) / size))
        rows = some.select(*KEYS, F.inline(F.transform(F.sequence(F.lit(0), F.col("_last").cast("int")), cut)))
        return rows.select(*KEYS, F.col("c").cast("long").alias("c"), F.col("lo").cast("long").alias("lo"), "part")
    first, last = F.floor((F.col("t") - after) / size), F.floor((F.col("t") + before) / size)
    near = F.sequence(F.greatest(first, F.lit(0)), last)
    rows = series.select(*KEYS, "t", "v", F.explode(near).alias("c"))
    part = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"])
    own = F.max((F.floor(F.col("t") / size) == F.col("c")).cast("int"))  # a chunk past the end would hold nothing but a halo
    return rows.groupBy(*KEYS, "c").agg(part.alias("part"), own.alias("_own")).where("_own = 1").select(*KEYS, "c", (F.col("c") * size).alias("lo"), "part")


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select(*KEYS, F.posexplode("vals").alias("t", "v")).withColumn("t", F.col("t").cast("long"))
