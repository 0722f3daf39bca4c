"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(name: str, columns: list[str]) -> str:
    """The name, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def partitions_of(df: DataFrame) -> int:
    """Input partitions of a plan, which grow with the data."""
    return max(1, df.rdd.getNumPartitions())


def running_start(df: DataFrame, key: str, part: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` over the parts of a key. df has one row for each (key, part)."""
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


#: What operators remember in this worker process, by operator: how to forget it.
_REMEMBERED: dict[str, Callable[[], object]] = {}


def takes_over(owner: str, forget: Callable[[], object] | None = None) -> None:
    """A worker process outlives its stage, so what other operators remember in it goes before a task of this one begins; its own
    memory, which `forget` drops, stays from task to task."""
    others = [k for k in _REMEMBERED if k != owner]
    for k in others:
        _REMEMBERED.pop(k)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if forget is not None:
        _REMEMBERED[owner] = forget


def text_slices(batch: pa.RecordBatch, size: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about `size` bytes of text each, so that what is made from a run stays small."""
    n = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def values(column: pa.Array) -> list:
    """Strings or binaries of a column, None where null."""
    return column.to_numpy(zero_copy_only=False).tolist()


def beside(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The columns `keep` of a batch as they are, ids exact and nulls null, and new ones beside them."""
    return pa.RecordBatch.from_arrays([*[batch[c] for c in keep], *map(pa.array, columns.values())], [*keep, *columns])
