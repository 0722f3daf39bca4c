"""Nearest subsequences: non-overlapping neighbours, close pairs, and motifs defined by a range.

No row carries a whole series: values lie in chunks of SIZE starts with a halo, and the window pairs of a series are tiles of two
chunks. A task takes on strips, a chunk of starts against the chunks it is compared with, which come to it one after the other in order;
only what a start still needs of the tiles seen is kept. n points are so shipped n / SIZE times, 8 n^2 / SIZE bytes in all, and strips
are dealt out evenly however many series there are. Columns beside those named are ignored; series without a full window have
no rows; values must not be null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import durable
from . import intervals as I
from . import series as S

SIZE, TILE = 4096, 256
WK = ["series_id", "attr_id"]
NEIGHBOURS = "series_id string, attr_id int, m int, start long, rank int, nbr long, dist double"


def size_of(series: DataFrame) -> int:
    """Starts of a chunk: SIZE, and four times as many beyond two million values, so that less is shipped."""
    n = F.sum(F.size("vals").cast("long")) if "vals" in series.columns else F.count("*")
    return SIZE if (series.agg(n.alias("n")).first().n or 0) < 1 << 21 else 4 * SIZE


def strips(series: DataFrame, widths: list[int], *, before: int = 0, extra: int = 0, later_only: bool = False, own_only: bool = False, size: int = SIZE, only: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """(series_id, attr_id, m, c, of, lo, part): for each width the chunks c of values part = [lo - before, lo + size + m - 1 + extra), each once
    for every chunk `of` whose starts are compared with its own; with later_only no chunk comes before `of`, with own_only there is no other. Rows of
    a strip are together and in order, its own chunk first. series is packed, a row for each value, or has such chunks of one width. With only (keys, m, of, ...; m may be left
    out) strips are those of its rows, with its columns; limits (keys, m, limit) adds its column, infinite where there is no row."""
    out = None
    for m in widths:
        own = (series if "part" in series.columns else S.chunks(series, size, before=before, after=m - 1 + extra)).where(F.size("part") >= m + F.least("lo", F.lit(before))).withColumn("m", F.lit(m))
        out = own if out is None else out.unionByName(own)
    if limits is not None:
        out = out.join(limits, [*WK, "m"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    if own_only:
        out = out.withColumn("of", F.col("c"))
    elif later_only:
        out = out.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), "c")))
    else:
        count = out.groupBy(*WK, "m").agg((F.max("c") + 1).alias("_k"))
        out = out.join(count, [*WK, "m"]).withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_k")
    out = out if only is None else out.join(only, [*WK, *(["m"] if "m" in only.columns else []), "of"])
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, *WK, "m", "of").sortWithinPartitions(*WK, "m", "of", (F.col("c") != F.col("of")).cast("int"), "c")


def tiles(batches: Iterator[pd.DataFrame] | Iterator[pa.RecordBatch], make) -> Iterator[tuple]:
    """(row, what `make` makes of the strip's own chunk, of this chunk, whether the strip starts here) of the rows of strips."""
    at = own = None
    for batch in batches:
        for r in (batch.to_pandas() if isinstance(batch, pa.RecordBatch) else batch).itertuples(index=False):
            here = make(r)
            new = (r.series_id, r.attr_id, r.m, r.of) != at
            if new:
                at, own = (r.series_id, r.attr_id, r.m, r.of), here
            yield r, own, here, new


def arrow(r, **columns: np.ndarray) -> pa.RecordBatch:
    """Columns beside the keys of the strip's row r."""
    n = len(next(iter(columns.values())))
    keys = {"series_id": pa.repeat(pa.scalar(r.series_id, pa.string()), n), "attr_id": pa.repeat(pa.scalar(int(r.attr_id), pa.int32()), n)}
    return pa.RecordBatch.from_pydict(keys | {k: pa.array(v) for k, v in columns.items()})


def subsequence_knn(series: DataFrame, m: list[int] | int, k: int, distance: str = "znormed_ed", slack: float = 0.5, size: int | None = None, limits: DataFrame | None = None, even: bool = False) -> DataFrame:
    """(keys, m, start, rank, nbr, dist): each start's k nearest starts that don't overlap, itself at distance 0 the first; the
    earlier start on ties. series is packed or a row for each value. With limits (keys, m, limit) only neighbours within the limit and the
    starts that have one: their lists are those without it, cut there. If `even`, with k = 2, starts half a window apart don't overlap from either end."""
    limited, size = limits is not None, size or size_of(series)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = key = None
        for r, own, here, new in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            if new:
                if held is not None:
                    yield neighbour_table(key, held)
                limit = r.limit if limited else np.inf
                key, held = (r.series_id, r.attr_id, r.m), K.Nearest(int(r.lo), own.n, k, int(r.m * slack), limit, even)
            held.add(own, here, int(r.c) * size, distance)
        if held is not None:
            yield neighbour_table(key, held)

    lengths = [m] if isinstance(m, int) else m
    return strips(series, lengths, size=size, limits=limits).mapInPandas(run, NEIGHBOURS)


def neighbour_table(key: tuple, held: K.Nearest) -> pd.DataFrame:
    start, rank, nbr, dist = held.neighbours()
    out = pd.DataFrame({"series_id": key[0], "attr_id": key[1], "m": key[2], "start": start, "rank": rank, "nbr": nbr, "dist": dist})
    return out if held.limit == np.inf else out[out["start"].isin(start[rank == 1])]


def knn_of_starts(series: DataFrame, starts: DataFrame, k: int, distance: str = "znormed_ed", slack: float = 0.5, size: int = SIZE) -> DataFrame:
    """The rows of subsequence_knn for starts (keys, m, pos), few of them in each series: n steps for each."""
    lengths = [r.m for r in starts.select("m").distinct().collect()]
    only = starts.groupBy(*WK, "m", F.floor(F.col("pos") / size).alias("of")).agg(F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias("at"))

    def run(batches):
        held = key = rows = None
        for r, own, here, new in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            if new:
                if held is not None:
                    yield neighbour_table(key, held)
                at = np.asarray(r.at, np.int64)
                key, rows = (r.series_id, r.attr_id, r.m), own.take(at - int(r.lo))
                held = K.Nearest(at, rows.n, k, int(r.m * slack))
            held.add(rows, here, int(r.c) * size, distance)
        if held is not None:
            yield neighbour_table(key, held)

    return strips(series, lengths, size=size, only=only).mapInPandas(run, NEIGHBOURS)


def dense_starts(series: DataFrame, m: list[int], k: int, distance: str = "znormed_ed", slack: float = 0.5, size: int = SIZE, few: int = 4) -> DataFrame:
    """(keys, m, pos): starts that have their 1 to k - 1 nearest neighbours close by, for each number the `few` best ones among those that see
    the windows of their own chunk only."""

    def run(batches):
        for r, own, here, _ in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            held = K.Nearest(int(r.lo), own.n, k, int(r.m * slack))
            held.add(own, here, int(r.lo), distance)
            start, rank, _, dist = held.neighbours()
            for n in range(1, k):
                at = np.flatnonzero(rank == n)
                at = at[np.lexsort((start[at], dist[at]))[:few]]
                yield pd.DataFrame({"series_id": r.series_id, "attr_id": r.attr_id, "m": r.m, "rank": n, "pos": start[at], "dist": dist[at]})

    found = strips(series, m, own_only=True, size=size).mapInPandas(run, "series_id string, attr_id int, m int, rank int, pos long, dist double")
    best = Window.partitionBy(*WK, "m", "rank").orderBy("dist", "pos")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= few).select(*WK, "m", "pos").distinct()


def subsequence_pairs(series: DataFrame, m: int, max_dist: float, distance: str = "znormed_ed", slack: float = 0.5, size: int | None = None, step: int = 1) -> DataFrame:
    """(keys, i, j, dist) of all pairs i < j of starts at multiples of `step` outside each other's zone with distance <= max_dist. series
    is packed or a row for each value."""
    h, size = max(int(m * slack), 1), size or size_of(series)

    def run(batches):
        for r, own, here, _ in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            first, other = int(r.of) * size, int(r.c) * size
            rows, columns = (np.flatnonzero((x + np.arange(w.n)) % step == 0) for x, w in ((first, own), (other, here)))
            a, b = (own, here) if step == 1 else (own.take(rows), here.take(columns))
            if not a.n or not b.n:
                continue
            for i, j, d in K.near_places(a, b, distance, np.full(a.n, float(max_dist))):
                i, j = first + rows[i], other + columns[j]
                if (ok := j >= i + h).any():
                    yield arrow(r, i=i[ok], j=j[ok], dist=d[ok])

    return strips(series, [m], later_only=True, size=size).mapInArrow(run, "series_id string, attr_id int, i long, j long, dist double")


def pairs_of_starts(series: DataFrame, starts: DataFrame, m: int, max_dist: float, distance: str = "znormed_ed", slack: float = 0.5, size: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """The rows of subsequence_pairs that have one of starts (keys, pos) as an end, from the windows of these against all others: n steps for
    each of them. Pairs of two of them come once. limits (keys, m, limit) is a further bound of a series."""
    h, size, limited = max(int(m * slack), 1), size or size_of(series), limits is not None

    def run(batches):
        for r, own, here, _ in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            first, other = int(r.of) * size, int(r.c) * size
            at = np.asarray(r.at, np.int64) - first
            at = at[at < own.n]
            for i, j, d in K.near_places(own.take(at), here, distance, np.full(len(at), min(float(max_dist), r.limit) if limited else float(max_dist))):
                x, y = first + at[i], other + j
                if (ok := np.abs(y - x) >= h).any():
                    x, y = x[ok], y[ok]
                    yield arrow(r, i=np.minimum(x, y), j=np.maximum(x, y), dist=d[ok])

    found = strips(series, [m], size=size, only=_by_chunk(starts, size), limits=limits).mapInArrow(run, "series_id string, attr_id int, i long, j long, dist double")
    return found.dropDuplicates([*WK, "i", "j"])


def _by_chunk(starts: DataFrame, size: int) -> DataFrame:
    """(keys, of, at): the starts (keys, pos) of each chunk."""
    return starts.groupBy(*WK, F.floor(F.col("pos") / size).alias("of")).agg(F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias("at"))


def reached(series: DataFrame, starts: DataFrame, m: int, limits: DataFrame, distance: str = "znormed_ed", slack: float = 0.5, size: int | None = None) -> DataFrame:
    """(keys, o): the starts within the limit of their series (keys, m, limit) of one of starts (keys, pos) and outside its zone. A start found is
    compared with no more starts of that chunk, so no pairs are made."""
    h, size = max(int(m * slack), 1), size or size_of(series)

    def run(batches):
        for r, own, here, _ in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            first, other = int(r.of) * size, int(r.c) * size
            at, left = np.asarray(r.at, np.int64) - first, np.ones(here.n, bool)
            at = at[at < own.n]
            for lo in range(0, len(at), TILE):
                rows, columns = at[lo : lo + TILE], np.flatnonzero(left)
                if not len(columns):
                    break
                for i, j, _ in K.near_places(own.take(rows), here if len(columns) == here.n else here.take(columns), distance, np.full(len(rows), float(r.limit))):
                    j = columns[j]
                    left[j[np.abs(other + j - first - rows[i]) >= h]] = False
            if not left.all():
                yield arrow(r, o=other + np.flatnonzero(~left))

    return strips(series, [m], size=size, only=_by_chunk(starts, size), limits=limits).mapInArrow(run, "series_id string, attr_id int, o long").distinct()


def most_matches(series: DataFrame, m: int, ranges: list[float], closest: bool = False, distance: str = "znormed_ed", slack: float = 0.5, size: int | None = None) -> DataFrame:
    """(keys, r, start, n, var): for each range the start of k_motifs, the number of its matches and the variance of their distances; with closest
    also rows of r 0 for the ends of the closest pair or pairs within the largest range, their distance in var. The matches of a start
    are counted where they are found, chunk after chunk, so no pairs are made; a task keeps the starts that have most of those it has."""
    h, size, top = max(int(m * slack), 1), size or size_of(series), float(max(ranges))

    def table(key, held):
        for r, start, n, every, var in held.most():
            yield pd.DataFrame({"series_id": key[0], "attr_id": key[1], "r": float(r), "start": start, "n": n, "every": every, "var": var})
        if closest and len(held.ends):
            yield pd.DataFrame({"series_id": key[0], "attr_id": key[1], "r": 0.0, "start": held.ends, "n": 0, "every": 0, "var": held.least})

    def run(batches):
        held = key = own_places = None
        for r, own, here, new in tiles(batches, lambda r: K.Windows(np.asarray(r.part, float), r.m, size)):
            first, other = int(r.of) * size, int(r.c) * size
            if new:
                if held is not None:
                    held.add(*own_places) if own_places else None
                    yield from table(key, held)
                key, held = (r.series_id, r.attr_id), K.Matches(first, own.n, ranges, m)
            elif own_places and r.c > r.of:  # places come in order
                held.add(*own_places)
                own_places = None
            found = [(i, other + j, d) for i, j, d in K.near_places(own, here, distance, np.full(own.n, top))]
            found = [tuple(x[np.abs(p - first - i) >= h] for x in (i, p, d)) for i, p, d in found]
            found += [(np.arange(own.n), first + np.arange(own.n), np.zeros(own.n))] if new else []
            places = tuple(np.concatenate(x) for x in zip(*found)) if found else None
            if new:
                own_places = places
            elif places:
                held.add(*places)
        if held is not None:
            held.add(*own_places) if own_places else None
            yield from table(key, held)

    rows = strips(series, [m], size=size).mapInPandas(run, "series_id string, attr_id int, r double, start long, n long, every long, var double")
    rows = durable(rows, "most-matches") if closest else rows
    each = rows.where("n > 0").groupBy(*WK, "r", "n").agg(F.min(F.struct("start", "var")).alias("_f"), F.min(F.when(F.col("every") > F.col("n"), F.struct("var", "start"))).alias("_w"))
    best = each.groupBy(*WK, "r").agg(F.max(F.struct("n", F.least(F.struct("_f.var", "_f.start"), "_w").alias("x"))).alias("_b"))
    best = best.select(*WK, "r", "_b.x.start", "_b.n", "_b.x.var")
    if not closest:
        return best
    ends = rows.where("n = 0")
    least = ends.groupBy(*WK).agg(F.min("var").alias("var"))
    return best.unionByName(ends.join(least, [*WK, "var"]).select(*WK, "r", "start", "n", "var").distinct())


def order_by_kth_distance(knn: DataFrame, k: int, bound: float | None = None) -> DataFrame:
    """(keys, m, start, dist, place): anchors in the order of their (k-1)-th neighbour's distance (8 digits), the earlier start on ties. With
    a bound those beyond it stay out: an extent of `bound` found already can't be bettered from there."""
    kth = knn.where(F.col("rank") == k - 1)
    kth = kth if bound is None else kth.where(F.col("dist") < bound)
    w = Window.partitionBy(*WK, "m").orderBy(F.round("dist", 8), "start")
    return kth.select(*WK, "m", "start", "dist", F.row_number().over(w).alias("place"))


def similarity_pairs(series: DataFrame, radius: int, least: float, skip: list[tuple[int, int]] | None = None, size: int | None = None) -> DataFrame:
    """(keys, i, j, similarity) of centred windows scaled to their own range: 1 / (1 + distance) >= least, i < j.

    Windows reach from i - radius to i + radius, less at the ends; pairs are compared over the shorter length. Centres in
    the half-open `skip` regions stay out. series is packed or a row for each value."""

    bound, size = (1 / least - 1) ** 2 * (1 + 1e-9) + 1e-12 if least > 0 else np.inf, size or size_of(series)

    def centred(r):
        return K.Centred(np.asarray(r.part, float), min(int(r.c) * size, radius), radius, size)

    def run(batches):
        for r, own, here, _ in tiles(batches, centred):
            first, other = int(r.of) * size, int(r.c) * size
            out = lambda x: np.any([(x >= a) & (x < b) for a, b in skip or []] or [np.zeros(len(x), bool)], axis=0)
            for i, j, d in own.near(here, bound):
                i, j, s = first + i, other + j, 1 / (1 + np.sqrt(np.maximum(d, 0)))
                if (ok := (s >= least) & (j > i) & ~out(i) & ~out(j)).any():
                    yield arrow(r, i=i[ok], j=j[ok], similarity=s[ok])

    chunks = strips(series, [1], before=radius, extra=radius, later_only=True, size=size)
    return chunks.mapInArrow(run, "series_id string, attr_id int, i long, j long, similarity double")


def pair_motif(pairs: DataFrame) -> DataFrame:
    """The closest pair or pairs of each series."""
    least = pairs.groupBy(*WK).agg(F.min("dist").alias("dist"))
    return pairs.join(least, [*WK, "dist"]).select(*WK, "i", "j", "dist")


def both_ways(pairs: DataFrame) -> DataFrame:
    """(keys, start, o, dist): each pair from either end."""
    return pairs.select(*WK, F.col("i").alias("start"), F.col("j").alias("o"), "dist").unionByName(pairs.select(*WK, F.col("j").alias("start"), F.col("i").alias("o"), "dist"))


def closest_starts(directed: DataFrame) -> DataFrame:
    """(keys, pair_dist, top): the least distance of each series and the starts that have it, from either end."""
    least = directed.groupBy(*WK).agg(F.min("dist").alias("pair_dist"))
    own = directed.join(least, WK).where("dist = pair_dist").select(*WK, "pair_dist", F.explode(F.array("start", "o")).alias("s"))
    return own.groupBy(*WK, "pair_dist").agg(F.collect_set("s").alias("top"))


def _range_sets(directed: DataFrame, top: DataFrame, r: float, m: int) -> DataFrame:
    near = directed.join(top, WK).where((F.col("dist") <= F.lit(float(r)) - F.col("pair_dist")) & F.array_contains("top", F.col("start")))
    hits = near.groupBy(*WK).agg(F.collect_set("o").alias("hits"))
    sets = top.join(hits, WK, "left").withColumn("s", F.array_union("top", F.coalesce("hits", F.slice("top", 1, 0))))
    return sets.select(*WK, I.drop_trivial_matches(F.col("s"), m).alias("motif"), F.col("pair_dist").alias("dist"))


def range_motif(pairs: DataFrame, r: float, m: int, closest: DataFrame | None = None) -> DataFrame:
    """(keys, motif, dist): the starts of the closest pair (or pairs, on ties) and those within r less its distance of any of
    them, without trivial matches. pairs may be cut at r, and be those of the ends of the closest pairs only (pairs_of_starts), if
    closest (keys, i, j, dist) has the closest pairs of all series; a series without a pair has no row."""
    directed = both_ways(pairs)
    return _range_sets(directed, closest_starts(directed if closest is None else both_ways(closest)), r, m)


def k_motifs(pairs: DataFrame, r: float, m: int) -> DataFrame:
    """(keys, start, matches, var): the start with most matches within r, itself counted and trivial matches taken out; on ties
    the least variance of the distances of its matches, then the first start. Only a start with more matches before trivial
    ones go than the winning number can win a tie from the first one. A series without a pair within r has no row."""
    near = both_ways(pairs.where(F.col("dist") <= r))
    own = near.select(*WK, "start").distinct().select(*WK, "start", F.col("start").alias("o"), F.lit(0.0).alias("dist"))
    sets = near.unionByName(own).groupBy(*WK, "start").agg(F.collect_list(F.struct("o", "dist")).alias("x"), F.count("*").alias("_all"))
    sets = sets.withColumn("matches", I.drop_trivial_matches(F.transform("x", lambda e: e["o"]), m))
    kept = F.transform(F.filter("x", lambda e: F.array_contains("matches", e["o"])), lambda e: e["dist"])
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + f(v)) / F.size(c)
    sets = sets.withColumn("_d", kept).withColumn("_mean", total(F.col("_d"), lambda v: v)).withColumn("var", total(F.col("_d"), lambda v: (v - F.col("_mean")) ** 2))
    every = Window.partitionBy(*WK)
    sets = sets.withColumn("_n", F.size("matches")).withColumn("_most", F.max("_n").over(every)).where("_n = _most")
    sets = sets.withColumn("_first", F.min("start").over(every)).where("start = _first or _all > _most")
    w = every.orderBy("var", "start")
    return sets.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*WK, "start", "matches", "var")


def k_motifs_ranged(pairs: DataFrame, max_r: int, m: int) -> DataFrame:
    """(keys, r, motif): the closest pair (r 0), then for r from 1 by a tenth of max_r the set of k_motifs if it is larger than
    two and than all before it."""
    out = closest_starts(both_ways(pairs)).select(*WK, F.lit(0.0).alias("r"), F.array_sort("top").alias("motif"))
    for r in range(1, max_r + 1, max(1, max_r // 10)):
        out = out.unionByName(k_motifs(pairs, r, m).select(*WK, F.lit(float(r)).alias("r"), F.col("matches").alias("motif")))
    first = out.withColumn("_size", F.when(F.col("r") == 0, 2).otherwise(F.size("motif")))
    return keep_growing(first, F.col("_size"), WK, "r").drop("_size")


def range_motif_ranged(pairs: DataFrame, max_r: int, m: int, steps: int = 10) -> DataFrame:
    """(keys, r, motif): the closest pair (r 0), then for r from 1 in `steps` steps the set of range_motif if it is larger than
    two and than all before it; what lies within m / 2 of a set found is no neighbour of anything afterwards."""
    directed, half = durable(both_ways(pairs), "range-pairs"), m // 2
    out = [closest_starts(directed).select(*WK, F.lit(0.0).alias("r"), F.array_sort("top").alias("motif"), F.lit(2).alias("_n"))]
    for r in range(1, max_r + 1, max(1, max_r // steps)):
        most = out[0]
        for x in out[1:]:
            most = most.unionByName(x)
        sets = _range_sets(directed, closest_starts(directed), r, m).withColumn("_n", F.size("motif"))
        found = sets.join(most.groupBy(*WK).agg(F.max("_n").alias("_most")), WK).where("_n > _most").select(*WK, F.lit(float(r)).alias("r"), "motif", "_n")
        out.append(durable(found, "range-sets"))
        zones = out[-1].select(*WK, F.explode("motif").alias("p")).select(*WK, F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - half), F.col("p") + half - 1)).alias("o")).distinct()
        directed = durable(directed.join(zones, [*WK, "o"], "left_anti").select(*WK, "start", "o", "dist"), "range-pairs")
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.drop("_n")


def k_motifs_ranged_of(series: DataFrame, max_r: int, m: int, size: int | None = None) -> DataFrame:
    """k_motifs_ranged of all pairs of a series within max_r, none of which is made but those of the starts that win."""
    size = size or size_of(series)
    chunks = durable(S.chunks(series, size, after=m - 1), "range-chunks")
    ranges = [float(r) for r in range(1, max_r + 1, max(1, max_r // 10))]
    best = durable(most_matches(chunks, m, ranges, True, size=size), "most-matches")
    won = best.where("r > 0").select(*WK, "r", "start")
    near = both_ways(pairs_of_starts(chunks, won.select(*WK, F.col("start").alias("pos")).distinct(), m, max_r, size=size))
    near = near.join(won, [*WK, "start"]).where("dist <= r").select(*WK, "r", "o").unionByName(won.select(*WK, "r", F.col("start").alias("o")))
    sets = near.groupBy(*WK, "r").agg(F.collect_set("o").alias("_s")).select(*WK, "r", I.drop_trivial_matches(F.col("_s"), m).alias("motif"))
    pair = best.where("r = 0").groupBy(*WK, "r").agg(F.array_sort(F.collect_set("start")).alias("motif"))
    first = pair.unionByName(sets).withColumn("_size", F.when(F.col("r") == 0, 2).otherwise(F.size("motif")))
    return keep_growing(first, F.col("_size"), WK, "r").drop("_size")


def range_motif_ranged_of(series: DataFrame, max_r: int, m: int, steps: int = 10, size: int | None = None, few: int = 1024) -> DataFrame:
    """range_motif_ranged of all pairs of a series within max_r, which are not made.

    Each start's nearest one is found once, and the pairs as close as the nearest ones of about `few` starts are kept: the closest pair is among
    them. Where sets found have ruled out all of them, the starts that lost their nearest one and may still have the closest
    pair are searched again. A set is what one of the closest starts reaches."""
    size, half = size or size_of(series), m // 2
    chunks = durable(S.chunks(series, size, after=m - 1), "range-chunks")
    near = subsequence_knn(chunks, m, 2, size=size, even=True).where((F.col("rank") == 1) & (F.col("dist") <= float(max_r)))
    near = durable(near.select(*WK, "start", F.col("nbr").alias("o"), "dist"), "range-nearest")
    limit = lambda rows: rows.groupBy(*WK).agg(F.min("dist").alias("limit")).withColumn("m", F.lit(m))
    at = lambda rows: rows.select(*WK, F.col("start").alias("pos")).distinct()
    outside = lambda rows, zones: rows if zones is None else rows.join(zones, [*WK, "o"], "left_anti")

    halves = F.percentile_approx("dist", [0.5**k for k in range(25)], 100_000)  # of about `few` starts: any value will do
    place = F.greatest(F.lit(0), F.least(F.lit(24), F.floor(F.log2(F.count("*") / F.lit(few))))).cast("int")
    low = near.groupBy(*WK).agg(F.get(halves, place).alias("limit")).withColumn("m", F.lit(m))
    low = durable(low, "range-low")
    pairs = durable(both_ways(pairs_of_starts(chunks, at(near.join(low, WK).where("dist <= limit")), m, max_r, size=size, limits=low)), "range-pairs")

    def closest(zones):
        """(keys, pair_dist, s): the ends of the closest pairs into what is left."""
        rows = outside(pairs, zones)
        have = rows.join(limit(rows), WK).where("dist = limit").select(*WK, "limit", "start", "o")
        rest = near.join(rows.select(*WK).distinct(), WK, "left_anti")  # series none of whose close pairs is left
        if not rest.isEmpty():
            rows = outside(rest, zones)
            lost = rest.join(rows.select(*WK, "start"), [*WK, "start"], "left_anti").join(limit(rows), WK, "left").where("limit is null or dist <= limit")
            again = both_ways(pairs_of_starts(chunks, at(lost), m, max_r, size=size, limits=limit(rows)))
            rows = durable(rows.unionByName(outside(again, zones).select(*rows.columns)), "range-left")
            least = limit(rows)
            own = rows.join(least, WK).where("dist = limit")
            ends = outside(both_ways(pairs_of_starts(chunks, at(own), m, max_r, size=size, limits=least)), zones).join(least, WK).where("dist = limit")
            have = have.unionByName(own.select(*have.columns)).unionByName(ends.select(*have.columns))
        return durable(have.select(*WK, F.col("limit").alias("pair_dist"), F.explode(F.array("start", "o")).alias("s")).distinct(), "range-closest")

    ends, zones = closest(None), None
    out = [ends.groupBy(*WK).agg(F.array_sort(F.collect_set("s")).alias("motif")).select(*WK, F.lit(0.0).alias("r"), "motif", F.lit(2).alias("_n"))]
    every = out[0]
    for r in range(1, max_r + 1, max(1, max_r // steps)):
        reach = ends.groupBy(*WK).agg((F.lit(float(r)) - F.min("pair_dist")).alias("limit")).where("limit >= 0").withColumn("m", F.lit(m))
        hits = outside(reached(chunks, ends.join(reach, WK, "left_semi").select(*WK, F.col("s").alias("pos")), m, reach, size=size), zones)
        sets = ends.select(*WK, "s").unionByName(hits.select(*WK, F.col("o").alias("s"))).groupBy(*WK).agg(F.collect_set("s").alias("_s"))
        sets = sets.select(*WK, I.drop_trivial_matches(F.col("_s"), m).alias("motif")).withColumn("_n", F.size("motif"))
        most = every.groupBy(*WK).agg(F.max("_n").alias("_most"))
        found = durable(sets.join(most, WK).where("_n > _most").select(*WK, F.lit(float(r)).alias("r"), "motif", "_n"), "range-sets")
        if found.isEmpty():
            continue
        every = every.unionByName(found)
        new = found.select(*WK, F.explode("motif").alias("p")).select(*WK, F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - half), F.col("p") + half - 1)).alias("o"))
        zones = durable((new if zones is None else new.unionByName(zones)).distinct(), "range-zones")
        ends = closest(zones)
    return every.drop("_n")


def keep_growing(sets: DataFrame, size: Column, keys: list[str], order: str) -> DataFrame:
    """Sets strictly larger than every earlier one of their key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = sets.withColumn("_n", size)
    return rows.withColumn("_most", F.max("_n").over(w)).where("_most is null or _n > _most").drop("_n", "_most")
