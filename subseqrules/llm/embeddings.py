"""Embedding near-duplicates: an exact metric range join in cells.

On unit vectors cosine >= c is distance <= r = sqrt(2 - 2c). Pivots (a bounded sample of the vectors) cut the space into
cells of the nearest pivot. A vector belongs to its home cell and is sent as a query to a later cell only if that cell can
hold something within r: by the triangle inequality d(x, pivot) - d(x, home) <= 2r, and its distance to the plane between
the two pivots must be <= r. Each pair so meets once, in the later of its two cells. Cells are cut into blocks of bounded
size that join independently; inside a block pair, rows are ordered by distance to the pivot and only rings within r
are multiplied. Equal vectors are one row with a count and a number of its own, by which links are known; vec_id only
comes back at the end.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are
their own component; vectors of different lengths don't link; rows with equal or null ids are rows of their own that count
as others; component_id is the smallest id that is not null, null if all are, and kept means equal to it, null to null;
extra columns are ignored; an empty table gives an empty result. Where vectors spread evenly over many dimensions, r reaches into most cells and the join nears all pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, partitions_of, read_table
from .components import components
from .simhash import forest

COSINE, PIVOTS, BLOCK = 0.9, 8, 1 << 14


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that very small or large components don't leave the range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def reach(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each row, whether a row must be sent to each cell)."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home]
    apart = np.linalg.norm(pivots[home][:, None, :] - pivots[None], axis=2)
    plane = (d**2 - own[:, None] ** 2) / np.maximum(2 * apart, 1e-12)
    slack = r + 1e-9
    send = (d - own[:, None] <= 2 * slack) & (plane <= slack) & (np.arange(len(pivots))[None] >= home[:, None])
    send[np.arange(len(x)), home] = True
    return home, send


def near(d: np.ndarray, q: np.ndarray, least: float, pivot: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row of d, row of q) with cosine >= least."""
    dd, qd = np.sqrt(np.maximum(0, 2 - 2 * d @ pivot)), np.sqrt(np.maximum(0, 2 - 2 * q @ pivot))
    do, qo = np.argsort(dd), np.argsort(qd)
    for k in range(0, len(q), 256):
        part = qo[k : k + 256]
        lo, hi = np.searchsorted(dd[do], (qd[part[0]] - r - 1e-9, qd[part[-1]] + r + 1e-9))
        rows = do[lo:hi]
        i, j = np.nonzero(d[rows] @ q[part].T >= least)
        if len(i):
            yield rows[i], part[j]


def links(vectors: DataFrame, *, cosine=COSINE, pivots=PIVOTS, block=BLOCK) -> DataFrame:
    """vectors: node, copies, dim, vec (binary of doubles). Rows (node, linked, root): to be summed by node; root joins a forest."""
    spark, r = vectors.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rank = F.struct(F.xxhash64("node", F.lit(11)).alias("h"), "node", "vec")
    picked = vectors.groupBy("dim", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("k")).agg(F.min(rank).alias("p"))
    points: dict[int, list] = {}
    for row in picked.orderBy("dim", "k").collect():  # `pivots` vectors for each length of vectors
        points.setdefault(row.dim, []).append(np.frombuffer(row.p.vec, np.float64))
    shared = spark.sparkContext.broadcast({k: unit(np.array(v)) for k, v in points.items()})

    def route(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim", sort=False):
                x = matrix(own["vec"].tolist())
                home, send = reach(x, shared.value[dim], r)
                base = own[["dim", "node", "copies", "vec"]].reset_index(drop=True)
                yield base.assign(cell=home, role=0)
                i, to = np.nonzero(send)
                yield base.iloc[i].assign(cell=to, role=np.where(to == home[i], 1, 2))

    routed = durable(vectors.mapInPandas(route, "dim int, node long, copies long, vec binary, cell int, role int"), "vector-cells")
    sizes = routed.groupBy("dim", "cell", "role").agg(F.count("*").alias("n"))  # at most 3 rows for each pivot
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).alias("cut")
    packed = [F.collect_list(c).alias(c) for c in ("node", "copies", "vec")]
    blocks = routed.join(F.broadcast(sizes), ["dim", "cell", "role"]).groupBy("dim", "cell", "role", cut).agg(*packed)
    blocks = durable(blocks, "vector-blocks")
    data = blocks.where("role = 0").select("dim", "cell", "node", "copies", "vec")
    queries = blocks.where("role > 0").select("dim", "cell", "role", *[F.col(c).alias("q_" + c) for c in ("node", "copies", "vec")])

    def compare(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d, q = matrix(row.vec), matrix(row.q_vec)
                dn, qn = np.asarray(row.node), np.asarray(row.q_node)
                dc, qc = np.asarray(row.copies), np.asarray(row.q_copies)
                dsum, qsum, a, b = np.zeros(len(d), np.int64), np.zeros(len(q), np.int64), [], []
                for i, j in near(d, q, cosine, shared.value[row.dim][row.cell], r):
                    if row.role == 1:  # the cell's own vectors: each pair once
                        i, j = i[first := dn[i] < qn[j]], j[first]
                    np.add.at(dsum, i, qc[j])
                    np.add.at(qsum, j, dc[i])
                    a.append(dn[i])
                    b.append(qn[j])
                for n, s in ((dn, dsum), (qn, qsum)):
                    if s.any():
                        yield pd.DataFrame({"node": n[s > 0], "linked": s[s > 0], "root": n[s > 0]})
                if a and len(x := np.concatenate(a)):
                    n, root = forest(x, np.concatenate(b))
                    yield pd.DataFrame({"node": n, "linked": 0, "root": root})

    pairs = data.join(queries, ["dim", "cell"]).repartition(max(partitions_of(vectors), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return pairs.mapInPandas(compare, "node long, linked long, root long")


def embedding_links(rows: DataFrame, *, cosine=COSINE, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    value = F.col("embedding").cast("array<double>")
    usable = (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), value).alias("v"))
    some = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))

    def scale(batches):
        for batch in batches:
            own = [np.asarray(v, np.float64) for v in batch["v"].to_numpy(zero_copy_only=False)]
            yield beside(batch, ["least", "copies", "v"], dim=np.array(list(map(len, own)), np.int32), vec=[unit(v[None])[0].tobytes() for v in own])

    some = some.mapInArrow(scale, "least long, copies long, v array<double>, dim int, vec binary")
    some = durable(some.withColumn("node", F.monotonically_increasing_id()), "vectors")  # written: the numbers stay
    found = durable(links(some.select("node", "copies", "dim", "vec"), cosine=cosine, **how), "vector-links")
    roots = durable(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-roots")
    sums = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    some = some.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    some = some.select("v", "root", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    least = some.groupBy("root").agg(F.min("least").alias("component_id"))
    some = some.join(least, "root").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(some, "v").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark, sf_dir):
    return embedding_links(read_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS ok FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE ok),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n),
r AS (SELECT vec_id AS id, vec_id AS top FROM e UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(top) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.id = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
