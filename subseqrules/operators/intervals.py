"""Half-open intervals [a, b) as rows, joins on overlap, and greedy picks of starts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import durable


def mask_to_intervals(points: DataFrame, keys: list[str], mask: Column, width: int | None = None) -> DataFrame:
    """(keys, a, b) of the runs of consecutive t where mask is true. With a width, runs are found in chunks of so many t and then joined
    where they touch, so that a long key is many tasks. Null keys are a key."""
    cell = [] if width is None else [F.floor(F.col("t") / width).alias("_c")]
    rows = points.where(mask).select(*keys, "t", *cell)
    by = [*keys, *(["_c"] if cell else [])]
    run = rows.withColumn("_run", F.col("t") - F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    out = run.groupBy(*by, "_run").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b")).select(*keys, "a", "b")
    return out if width is None else merge_intervals(out, keys, width)


def missing_segments(points: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    return mask_to_intervals(points, keys, F.col("v").isNull(), width)


def carried(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows (keys, _c, ...) and `_before`, the largest value in the earlier cells _c of their key; only cells are put in order."""
    cells = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_c").alias("_cell")).agg(F.max(value).alias("_most"))
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.max("_most").over(earlier)).drop("_most")
    same = F.col("_c") == F.col("_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(cells, same).select(*rows.columns, "_before")


def merge_intervals(rows: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Overlapping and touching intervals become one; empty ones go. With a width, only intervals that start within so many places are put
    in order in one task, and how far earlier ones reach and where their islands start are carried from cell to cell."""
    rows = rows.where("b > a").select(*keys, "a", "b")
    if width is None:
        w = Window.partitionBy(*keys).orderBy("a", "b")
        rows = rows.withColumn("_before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("_island", F.sum(F.when(F.col("a") <= F.col("_before"), 0).otherwise(1)).over(w))
    else:
        rows = carried(rows.withColumn("_c", F.floor(F.col("a") / width)), keys, "b")
        w = Window.partitionBy(*keys, "_c").orderBy("a", "b")
        reach = F.greatest("_before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("_reach", reach).withColumn("_start", F.when(F.col("a") <= F.col("_reach"), None).otherwise(F.col("a")))
        rows = carried(rows.drop("_before"), keys, "_start")
        rows = rows.withColumn("_island", F.greatest("_before", F.max("_start").over(w)))  # starts rise: the last one is the largest
    return rows.groupBy(*keys, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def subtract_intervals(ranges: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """The free parts of ranges (keys, lo, hi) outside blocked (keys, a, b). ranges has one row for each key.

    A range's ends are put in order with the blocked intervals, lo first; a free part lies between a start and how far all before it reach. So a
    key is sorted once, and nothing is merged, joined or held in a hash table. Null keys meet nothing."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rows = blocked.where("b > a").where(whole).select(*keys, F.lit(1).alias("_k"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(None).cast("long").alias("_hi"))
    lo, hi, none = F.col("lo").cast("long"), F.col("hi").cast("long"), F.lit(None).cast("long")
    first = F.struct(F.lit(0).alias("_k"), lo.alias("a"), lo.alias("b"), hi.alias("_hi"))
    last = F.struct(F.lit(1).alias("_k"), hi.alias("a"), hi.alias("b"), none.alias("_hi"))
    rows = rows.unionByName(ranges.where("lo < hi").select(*keys, F.inline(F.array(first, last))))
    before = Window.partitionBy(*keys).orderBy("_k", "a").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max("b").over(before)).withColumn("_end", F.max("_hi").over(before))
    return rows.where("_end is not null and least(a, _end) > _reach").select(*keys, F.col("_reach").alias("a"), F.least("a", "_end").alias("b"))


def longest_free_run(ranges: DataFrame, blocked: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The longest free part of each range, the earliest on ties, and whether it is shorter than `least`."""
    free = subtract_intervals(ranges, blocked, keys)
    top = free.groupBy(*keys).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("_n"), (-F.col("a")).alias("_a"))).alias("_t"))
    top = top.select(*keys, (-F.col("_t._a")).alias("a"), (F.col("_t._n") - F.col("_t._a")).alias("b"))
    return top.withColumn("too_short", F.col("b") - F.col("a") < least)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of (keys, a, b) and (keys, c, d) that overlap: an equi-join on buckets of `width`, each pair kept in the bucket
    where the later of the two starts."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    x = left.where("b > a").withColumn("_cell", cells("a", "b"))
    y = right.where("d > c").withColumn("_cell", cells("c", "d"))
    return x.join(y, [*keys, "_cell"]).where("a < d and c < b").where(F.col("_cell") == F.floor(F.greatest("a", "c") / width)).drop("_cell")


def max_overlap_join(pred: DataFrame, occ: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """For each predicted interval (pred_id, a, b) the occurrence (occ_id, c, d) with the longest overlap, lowest id on ties."""
    both = overlapping(pred, occ, keys, width).withColumn("overlap", F.least("b", "d") - F.greatest("a", "c"))
    w = Window.partitionBy(*keys, "pred_id").orderBy(F.desc("overlap"), "occ_id")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def points_outside(points: DataFrame, blocked: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Points (keys, t) that lie in no interval. Points and intervals are put in order together, in cells of `width` places: a point is free
    unless an interval that starts at or before it reaches beyond it, so no pairs are made. Null keys meet nothing."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    a = blocked.where("b > a").where(whole)
    cut = F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width)))
    a = a.groupBy(*keys, F.col("a").cast("long").alias("a")).agg(F.max(F.col("b").cast("long")).alias("b")).select(*keys, "a", "b", cut.alias("_c"))
    a = a.select(*keys, "_c", F.greatest("a", F.col("_c") * width).alias("_t"), F.col("b").alias("_b"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_row"))
    p = points.select(*keys, F.floor(F.col("t") / width).alias("_c"), F.col("t").cast("long").alias("_t"), F.lit(None).cast("long").alias("_b"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*keys, "_c").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = p.unionByName(a).withColumn("_reach", F.max("_b").over(w))
    return rows.where(F.col("_row").isNotNull() & (F.col("_reach").isNull() | (F.col("_reach") <= F.col("_t")))).select("_row.*")


def starts_outside(starts: DataFrame, blocked: DataFrame, keys: list[str], m: int, column: str = "start", width: int = 64) -> DataFrame:
    """Rows whose window [start, start + m) meets no blocked interval."""
    own = starts.select(*keys, F.col(column).alias("a"), (F.col(column) + m).alias("b")).distinct()
    hit = overlapping(own, blocked.select(*keys, F.col("a").alias("c"), F.col("b").alias("d")), keys, width)
    hit = hit.select(*keys, F.col("a").alias(column)).distinct()
    return starts.join(hit, [*keys, column], "left_anti")


def greedy_starts(starts: Column, gap: float | int, strict: bool) -> Column:
    """Ascending greedy picks of an array of starts: kept if at least `gap` (strict: more) after the last kept."""
    far = (lambda x, last: x > last + gap) if strict else (lambda x, last: x >= last + gap)
    zero = F.slice(F.array_sort(starts), 1, 0)
    return F.aggregate(F.array_sort(starts), zero, lambda acc, x: F.when((F.size(acc) == 0) | far(x, F.element_at(acc, -1)), F.concat(acc, F.array(x))).otherwise(acc))


def _begins(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Where rows differ from the one before them in a key; the first one from `last`, a row or nothing. Null and NaN are equal to themselves."""
    rows = pa.Table.from_batches([batch] if last is None else [last, batch]).select(keys).combine_chunks()
    new = np.zeros(rows.num_rows, bool)
    for k in keys:
        column = rows[k].combine_chunks() if isinstance(rows[k], pa.ChunkedArray) else rows[k]
        x, y = column[:-1], column[1:]
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(x.is_null(nan_is_null=pa.types.is_floating(x.type)), y.is_null(nan_is_null=pa.types.is_floating(x.type))))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    new[0] = True
    return new if last is None else new[1:]


def _exits(batches: Iterator[pa.RecordBatch], by: list[str], width: int) -> Iterator[pa.RecordBatch]:
    """(by, last, out, count) of each chunk, its rows coming one after the other and in order: many chunks are solved at once, and only
    the last one of a batch waits for more."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        t, reach, until, c = (batch[k].to_numpy() for k in ("_at", "_reach", "_until", "_c"))
        first = np.flatnonzero(_begins(batch, by, None))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
        keep, out, count = K.orbit_exits_of_chunks(of, t - c * width, np.clip(reach - c * width, 0, width), reach, until - c * width, width)
        return pa.RecordBatch.from_arrays([*[batch[k].take(pa.array(keep)) for k in by], *map(pa.array, (t[keep], out, count))], [*by, "last", "out", "count"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < 1 << 16:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        start = int(np.flatnonzero(_begins(rows.to_batches()[0], by, None))[-1])
        if start:
            yield solved(rows.slice(0, start))
        held, n = [x for x in rows.slice(start).to_batches() if x.num_rows], 0
    held = [x for x in held if x.num_rows]
    if held:
        yield solved(pa.Table.from_batches(held))


def _entries(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, _c, entry, base): where the pick enters each chunk and how many are taken before it, from the exits of all chunks of a key, which
    come one after the other and in order."""
    last, chunk, at, taken, served = None, None, 0, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        keep, entry, base = [], [], []
        columns = [batch[k].to_pylist() for k in ("_c", "last", "out", "count")]
        for i, (new, c, x, out, count) in enumerate(zip(_begins(batch, keys, last).tolist(), *columns)):
            if new:
                at, taken = -(2**63), 0
            if new or c != chunk:
                chunk, served = c, False
            if not served and x >= at:
                served = True
                keep.append(i)
                entry.append(at)
                base.append(taken)
                at, taken = out, taken + count
        last = batch.slice(batch.num_rows - 1)
        yield pa.RecordBatch.from_arrays([*[batch[k].take(pa.array(keep, pa.int64())) for k in [*keys, "_c"]], pa.array(entry, pa.int64()), pa.array(base, pa.int64())], [*keys, "_c", "entry", "base"])


def _picks(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows taken of each chunk and their places; a chunk begins with the row (_k 0) that says where it is entered, if it is at all."""
    last, at, place = None, 2**63, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keep, places = [], []
        for i, (new, k, t, reach) in enumerate(zip(_begins(batch, by, last).tolist(), *[batch[c].to_pylist() for c in ("_k", "_at", "_reach")])):
            if new:
                at = 2**63
            if k == 0:
                at, place = t, reach
            elif t >= at:
                keep.append(i)
                places.append(place)
                at, place = reach, place + 1
        last = batch.slice(batch.num_rows - 1)
        taken = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch[c].take(taken) for c in columns], pa.array(places, pa.int64())], [*columns, "place"])


def greedy_rows(rows: DataFrame, keys: list[str], order: list[str], gap: Column, width: int = 1 << 16) -> DataFrame:
    """The rows that an ascending pick takes of each key, and their number `place` from 0: the first in `order` (a whole-numbered column
    first), then always the next that is at least `gap` after the last one taken.

    A pick depends on what came before only by how far the last one reaches, so chunks of `width` are solved apart: each says how a pick
    leaves it for every way to enter; these short tables are followed in order for each key, and then each chunk
    takes its rows. Long keys are many tasks, a task holds no more than the rows of `width` places beyond a batch, and chunks stay rows, so that
    many small ones cost no call each. Null keys are a key; rows with a null place or gap are left out; equal rows are taken at most once
    unless the gap is 0."""
    columns, by = rows.columns, [*keys, "_c"]
    at = F.col(order[0]).cast("long")
    rows = rows.withColumn("_at", at).withColumn("_reach", at + gap.cast("long")).where("_at is not null and _reach is not null")
    rows = durable(rows.withColumn("_c", F.floor(F.col("_at") / width)), "greedy-rows")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = lambda names: ", ".join(f"`{c}` {kind[c]}" for c in names)
    top = rows.agg(F.greatest(F.max(F.col("_reach") - F.col("_at")), F.lit(0)).alias("_top"))  # one row
    own = rows.select(*by, "_at", "_reach", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).crossJoin(F.broadcast(top))
    own = own.withColumn("_until", F.col("_c") * width + F.col("_top")).drop("_top")
    exits = own.repartition(*by).sortWithinPartitions(*by, *[f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    exits = exits.mapInArrow(lambda b: _exits(b, by, width), f"{fields(by)}, last long, out long, count long")
    ways = exits.repartition(*keys).sortWithinPartitions(*by, "last").mapInArrow(lambda b: _entries(b, keys), f"{fields(by)}, entry long, base long")
    enter = ways.select(*by, F.lit(0).alias("_k"), F.col("entry").alias("_at"), F.col("base").alias("_reach"))
    both = rows.withColumn("_k", F.lit(1)).unionByName(enter, allowMissingColumns=True)
    placed = both.repartition(*by).sortWithinPartitions(*by, "_k", *order)
    return placed.mapInArrow(lambda b: _picks(b, by, columns), f"{fields(columns)}, place long")


def filter_close_starts(starts: Column, m: int, minimum_interval: float = 1.0) -> Column:
    return greedy_starts(starts, int(m * minimum_interval), strict=False)


def drop_trivial_matches(starts: Column, m: int) -> Column:
    return greedy_starts(starts, m / 2, strict=True)


def companion_join(first: DataFrame, others: DataFrame, coef: DataFrame, width: int = 64) -> DataFrame:
    """Extend each first-side occurrence (occ_id, t1) by one occurrence of every other side (pos, occ_id, t1, delta): the side's
    start is predicted as slope * t1 + intercept (coef: pos, slope, intercept) and the occurrence that overlaps
    [start, start + delta) longest is taken; a first occurrence that lacks any side goes. Returns (occ_id, occs).

    Predictions of equal starts t1 are alike, and of occurrences at one place the lowest id is taken: only different starts meet different
    places, however many rows share them."""
    sides = coef.count()
    if sides > 1000:
        raise ValueError("a rule has at most 1000 sides")
    length = others.groupBy("pos").agg(F.max("delta").alias("_len"))
    coef = coef.join(length, "pos")  # a row for each other side
    start = F.rint(F.col("slope") * F.col("t1") + F.col("intercept")).cast("long")
    pred = first.select("t1").distinct().crossJoin(F.broadcast(coef)).select("pos", F.col("t1").alias("pred_id"), start.alias("a"), (start + F.col("_len")).alias("b"))
    occ = others.select("pos", "occ_id", F.col("t1").alias("c"), (F.col("t1") + F.col("delta")).alias("d"))
    occ = occ.groupBy("pos", "c", "d").agg(F.min(F.struct("occ_id")).alias("_x")).select("pos", "c", "d", "_x.occ_id")
    found = max_overlap_join(pred, occ, ["pos"], width)
    best = found.groupBy(F.col("pred_id").alias("t1")).agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("overlap")).alias("_o"), "occ_id"))).alias("_x"))
    got = first.select(F.col("occ_id").alias("pred_id"), "t1").join(best, "t1")
    got = got.groupBy("pred_id").agg(F.array_sort(F.flatten(F.collect_list("_x"))).alias("_x"))  # an id with several starts: of each side the best
    got = got.withColumn("_x", F.filter("_x", lambda x, i: (i == 0) | (x["pos"] != F.get("_x", F.greatest(i - 1, F.lit(0)))["pos"])))
    return got.where(F.size("_x") == sides).select(F.col("pred_id").alias("occ_id"), F.concat(F.array("pred_id"), F.transform("_x", lambda x: x["occ_id"])).alias("occs"))


def nearest_start(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each (keys, id, at) the right (keys, occ_id, t1) nearest in time, the earlier on ties; as-of both ways in one sort."""
    right = right.groupBy(*keys, "t1").agg(F.min("occ_id").alias("occ_id"))
    kind = right.schema["occ_id"].dataType.simpleString()
    rows = left.select(*keys, F.col("at").alias("_t"), F.col("id"), F.lit(None).cast(f"struct<t: bigint, o: {kind}>").alias("r"), F.lit(1).alias("_q"))
    occ = right.select(*keys, F.col("t1").alias("_t"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), F.struct(F.col("t1").cast("long").alias("t"), F.col("occ_id").alias("o")).alias("r"), F.lit(0).alias("_q"))
    w = Window.partitionBy(*keys).orderBy("_t", "_q")
    rows = rows.unionByName(occ)
    rows = rows.withColumn("_p", F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("r", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = F.col("_t") - F.col("_p.t"), F.col("_n.t") - F.col("_t")
    pick = F.when(F.col("_n").isNull() | (back <= ahead), F.col("_p")).otherwise(F.col("_n"))
    return rows.where("_q = 1").select(*keys, "id", F.col("_t").alias("at"), pick["t"].alias("t1"), pick["o"].alias("occ_id"))
