"""Sources and sinks: CSV, Parquet and JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..session import durable


def number(c: str) -> Column:
    """A column as double; what doesn't parse, and NaN, is null."""
    v = F.col(f"`{c}`").try_cast("double")
    return F.when(~F.isnan(v), v)


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, header=header)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with t, the row's position in the order of a column, in two levels: ranges of the column are numbered each for itself
    and start after the rows of the ranges before. They are written once, so that order and ranges stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = durable(df.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn("_r", own).join(counts.select("_p", before.alias("_before")), "_p").withColumn("t", (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_p", "_r", "_before")


def melt_wide(df: DataFrame, *, order_col: str | None = None, series_id: str = "s", fill: float | None = 0.0) -> DataFrame:
    """Wide rows to `series`: a column's position is its attr_id, a row's position by order_col its t. Without order_col
    the order is that of the rows as read. Unparsable and NaN values become `fill` (None: NULL)."""
    cols = [c for c in df.columns if c != order_col]
    values = [F.coalesce(number(c), F.lit(fill)).alias(str(i)) if fill is not None else number(c).alias(str(i)) for i, c in enumerate(cols)]
    key = F.struct(number(order_col), F.col(f"`{order_col}`")) if order_col else F.monotonically_increasing_id()
    rows = df.select(key.alias("_at"), *values)
    rows = numbered(rows, "_at").drop("_at")
    long = rows.unpivot("t", [str(i) for i in range(len(cols))], "attr_id", "v")
    return long.select(F.lit(series_id).alias("series_id"), F.col("attr_id").cast("int").alias("attr_id"), "t", "v")


def read_wide_series(spark: SparkSession, path: str, order_col: str | None = None, series_id: str = "s", fill: float | None = 0.0) -> DataFrame:
    return melt_wide(read_csv(spark, path), order_col=order_col, series_id=series_id, fill=fill)


def samples_from(df: DataFrame, split: str = "train", id_col: str | None = None) -> DataFrame:
    """Labelled rows: the first column is the class, the others are the values; NULLs are dropped from them."""
    cols = [c for c in df.columns if c != id_col]
    vals = F.filter(F.array(*[number(c) for c in cols[1:]]), lambda x: x.isNotNull())
    at = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    return df.select(at.alias("sample_id"), number(cols[0]).alias("label"), vals.alias("vals"), F.lit(split).alias("split"))


def read_samples(spark: SparkSession, path: str, header: bool = False, split: str = "train") -> DataFrame:
    return samples_from(read_csv(spark, path, header), split)


def align_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """The test rows with the train columns in their order, numeric with 0 for what doesn't parse; `idx` goes."""
    cols = [c for c in train.columns if c != "idx"]
    if missing := [c for c in cols if c not in test.columns]:
        raise ValueError(f"the test data lack {missing}")
    return test.select(*[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in cols])


def label_column(columns: list[str]) -> str:
    named = [c for c in ("label", "y_true", "y", "anomaly") if c in columns]
    rest = [c for c in columns if c.lower() not in ("idx", "index", "time")]
    if not (named or rest):
        raise ValueError("no label column")
    return (named or rest)[0]


def point_labels(df: DataFrame, order_col: str | None = None, count: int | None = None) -> DataFrame:
    """(t, label) with label 1 where the value is over 0."""
    c = label_column([x for x in df.columns if x != order_col] or df.columns)
    if count is not None and df.count() != count:
        raise ValueError("labels and rows differ in number")
    key = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = df.select(key.alias("_at"), (F.coalesce(number(c), F.lit(0.0)) > 0).cast("int").alias("label"))
    return numbered(rows, "_at").select("t", "label")


def single_series(df: DataFrame, column: str | int | None = None, order_col: str | None = None) -> DataFrame:
    """(t, v) of one column by name, position or the first numeric one; NULLs are dropped and t is renumbered."""
    cols = [c for c in df.columns if c != order_col]
    if isinstance(column, int):
        column = cols[column]
    if column is None:
        kinds = dict(df.dtypes)
        numeric = [c for c in cols if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
        counts = None if numeric else df.agg(*[F.count(number(c)).alias(c) for c in cols]).first().asDict()
        numeric = numeric or [c for c in cols if counts[c]]
        column = numeric[0] if numeric else cols[0]
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    key = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = df.select(key.alias("_at"), number(column).alias("v")).where("v is not null")
    return numbered(rows, "_at").select("t", "v")


def read_single_series(spark: SparkSession, path: str, column: str | int | None = None) -> DataFrame:
    out = single_series(read_csv(spark, path), column)
    if out.isEmpty():
        raise ValueError("the series is empty")
    return out


def baseline_flags(pred: DataFrame, points: DataFrame) -> DataFrame:
    """(t, y_pred) of a baseline for every point; both must have the same rows."""
    both = points.select("t").join(pred.select(F.col("t").alias("p"), "y_pred"), F.col("t") == F.col("p"), "full_outer")
    odd = F.raise_error(F.lit("baseline and points differ in rows"))
    return both.select(F.when(F.col("t").isNull() | F.col("p").isNull(), odd.cast("long")).otherwise(F.col("t")).alias("t"), F.col("y_pred").cast("int").alias("y_pred"))


def baseline_logits(logits: DataFrame, rows: DataFrame, classes: int) -> DataFrame:
    """Sparse (row_id, class_pos, logit) to one row for each row and class; what is absent is 0."""
    every = rows.select("row_id").withColumn("class_pos", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return every.join(logits.select("row_id", "class_pos", "logit"), ["row_id", "class_pos"], "left").fillna(0.0, ["logit"])


def write_artifacts(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def read_artifacts(spark: SparkSession, path: str, *, rules: str | None = None, keep_empty: bool = False) -> DataFrame:
    """A stored table; rows whose array column `rules` is empty go unless keep_empty."""
    df = spark.read.parquet(path)
    return df if keep_empty or not rules else df.where(F.size(rules) > 0)


def write_motif_sets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_motif_sets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def ground_truth(df: DataFrame, column: str, factor: int = 1) -> DataFrame:
    """Nested literal lists as array<array<int>>; positions divided by the down-sampling factor."""
    sets = F.from_json(column, "array<array<int>>")
    return df.withColumn(column, F.transform(sets, lambda s: F.transform(s, lambda x: F.floor(x / factor).cast("int"))))


def normalized_series(series: DataFrame, target_n: int = 10_000) -> DataFrame:
    """Down-sampled to about target_n points, then z-scored."""
    return S.zscore(S.downsample_to(series, target_n))
