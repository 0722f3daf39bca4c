"""SimHash near-duplicates: fingerprints, and all pairs within a Hamming distance by vantage-point trees.

Distinct fingerprints only take part in the search. The top of the tree is built on the driver from a bounded sample of
fingerprints (SAMPLE, a parameter): each inner node holds a vantage point and the median distance to it. Every
fingerprint goes to the leaf where it belongs; as a query it also goes to each later leaf that the triangle inequality
cannot rule out, that is, to both sides of a node wherever its distance to the vantage point is within `radius` of the
border. So each pair meets in exactly one leaf, the later of its two. In 64 dimensions a query visits most of a deep tree, so
the shared tree has about the square root of n / LEAF leaves, which keeps the copies few. Leaves are cut into blocks of bounded size, each
pair of a data and a query block is a task's unit, and inside it a smaller tree of the same kind prunes before distances
are compared. A leaf with very many near copies thus becomes many block pairs, not one large task.

Only a forest of the links found leaves a block pair (no link between different fingerprints is lost for the components).

Defined results: null and empty texts and texts without words have fingerprint 0 and are linked like any other; texts
of fewer than four words are one shingle; equal ids give a row each, null ids too; component_id is the smallest id that is
not null, null only if all of the component are; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, partitions_of, read_table, values
from .components import components

SHINGLE, RADIUS, SAMPLE, LEAF, BLOCK = 4, 4, 1 << 15, 1500, 8192
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BREAKS = re.compile(rb"[\x20\x09-\x0D]+")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bit 0 first
        part = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the XXH64 hashes of word shingles: a bit is set if over half the shingles have it."""
    import xxhash

    words = [w for w in BREAKS.split((text or "").translate(LOWER).encode("utf-8", "replace")) if w]
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, size) for t in values(batch["text"])), np.uint64, batch.num_rows)
            yield beside(batch, ["doc_id"], fp=fp.view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Nodes (vantage point, border) in heap order over `depth` levels; below a border lies what is nearer than it."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.points = np.zeros(1 << self.depth, np.uint64)
        self.borders = np.zeros(1 << self.depth, np.int16)
        groups = {1: np.sort(sample)}
        for node in range(1, 1 << self.depth):
            own = groups.pop(node, sample[:0])
            if len(own):
                self.points[node] = own[len(own) // 2]
                d = distance(own, self.points[node])
                self.borders[node] = np.median(d)
                groups[2 * node], groups[2 * node + 1] = own[d < self.borders[node]], own[d >= self.borders[node]]

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into fps, leaf) of every leaf that may hold something within radius; radius 0: where it belongs."""
        at, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            d, border = distance(fps[at], self.points[node]), self.borders[node]
            near, far = d - radius < border, d + radius >= border
            at = np.concatenate((at[near], at[far]))
            node = np.concatenate((2 * node[near], 2 * node[far] + 1))
        return at, node


def close_pairs(data: np.ndarray, queries: np.ndarray, radius: int, di=None, qi=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (data, query) within radius, by a vantage-point tree over the data that the queries descend."""
    di = np.arange(len(data)) if di is None else di
    qi = np.arange(len(queries)) if qi is None else qi
    if not len(di) or not len(qi):
        return
    if len(di) > 128:
        point = data[di[len(di) // 2]]
        d, q = distance(data[di], point), distance(queries[qi], point)
        border = np.median(d)
        near = d < border
        if near.any():
            yield from close_pairs(data, queries, radius, di[near], qi[q - radius < border])
            yield from close_pairs(data, queries, radius, di[~near], qi[q + radius >= border])
            return
        inside = q - radius <= d.max()  # all at one distance or beyond; nothing to halve
        qi = qi[inside]
    for k in range(0, len(qi), 4096):
        i, j = np.nonzero(np.bitwise_count(data[di][:, None] ^ queries[qi[k : k + 4096]][None, :]) <= radius)
        if len(i):
            yield di[i], qi[k : k + 4096][j]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) edges that keep together what the pairs (a, b) link."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, *, radius=RADIUS, sample=SAMPLE, leaf=LEAF, block=BLOCK) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints (column fp) within radius of each other."""
    spark, n = fps.sparkSession, fps.count()
    leaves = min(math.isqrt(n // leaf) + 1, sample // 8)
    share = min(1.0, 2.0 * sample / max(1, n))
    picked = [r.fp for r in fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample).collect()]
    tree = VantageTree(np.array(picked, np.int64).view(np.uint64), leaves)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches):
        t = shared.value
        for pdf in batches:
            x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            at, home = t.route(x, 0)
            own = np.empty(len(x), np.int64)
            own[at] = home
            yield pd.DataFrame({"leaf": own, "query": False, "fp": x.view(np.int64)})
            q, to = t.route(x, radius)
            q, to = q[keep := to >= own[q]], to[keep]
            yield pd.DataFrame({"leaf": to, "query": True, "fp": x[q].view(np.int64)})

    routed = durable(fps.select("fp").mapInPandas(route, "leaf long, query boolean, fp long"), "simhash-leaves")
    sizes = routed.groupBy("leaf", "query").agg(F.count("*").alias("n"))  # at most two rows for each leaf of the tree
    cut = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / block))
    blocks = routed.join(F.broadcast(sizes), ["leaf", "query"]).groupBy("leaf", "query", cut.alias("cut")).agg(F.collect_list("fp").alias("fps"))
    blocks = durable(blocks, "simhash-blocks")
    data = blocks.where("not query").select("leaf", F.col("fps").alias("data"))
    pairs = data.join(blocks.where("query").select("leaf", F.col("fps").alias("queries")), "leaf")

    def compare(batches):
        for pdf in batches:
            out = []
            for d, q in zip(pdf["data"], pdf["queries"]):
                d, q = np.asarray(d, np.int64), np.asarray(q, np.int64)
                for i, j in close_pairs(d.view(np.uint64), q.view(np.uint64), radius):
                    if (other := d[i] != q[j]).any():
                        out.append(forest(d[i][other], q[j][other]))
            for a, b in [forest(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))] if out else []:
                yield pd.DataFrame({"a": a, "b": b})

    spread = pairs.repartition(max(partitions_of(fps), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInPandas(compare, "a long, b long")


def simhash_components(docs: DataFrame, *, size=SHINGLE, radius=RADIUS, **how) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most radius bits lead to."""
    marked = durable(fingerprints(docs, size), "simhash-fps")
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = durable(components(links(distinct, radius=radius, **how)), "simhash-roots")
    distinct = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = distinct.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(distinct.join(least, "root").select("fp", "component_id"), "fp")


def op2_simhash(spark, sf_dir):
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
