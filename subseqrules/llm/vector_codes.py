"""Vector code compression: product codes from integer k-means, exact by limb-split matrix products.

Components become integers floor(scale * x). A vector is cut into equal consecutive parts, each with a codebook of its own; a
round assigns every part to the nearest entry and replaces entries by the floored mean of their parts. A squared
distance is |x|^2 - 2 x.c + |c|^2, and the products x.c of a batch are matrix products: each integer is broken into limbs, the
low ones in [0, 2^LIMB), the highest with the sign, so that every float64 product and its sum stay below 2^53 and
BLAS returns them exactly; shifted together in int64 they are the exact products. The first least distance is the code, so no
result depends on rounding, on the order of rows or on how many tasks there are.

A round is one pass: tasks add up counts and sums of their own rows, groups of (part, entry) are summed in Spark,
and only the new codebooks, of `parts` x `entries` rows, come to the driver and go out again.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, and so are those of another
length than the first one's (in order of vec_id, nulls last, equal ids by their vectors); a length that `parts` does not divide is an
error. Rows with a component beyond 2^26 after scaling can't be summed in 64 bits: they get a null code and error and
enter no codebook. With fewer rows than entries the codebook has that many. Equal and null ids are rows of their own; null
labels count as one label; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMB, LIMBS = 14, 2  # two limbs reach up to 2^27; products of limbs are below 2^28, so that 2^25 of them can be added up
RANGE, ROWS = 1 << 26, 1 << 14


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as float64 limbs, lowest first: x = sum of limb[i] * 2^(i * LIMB)."""
    out = []
    for _ in range(LIMBS - 1):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices, exact."""
    out = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c)
    for i, a in enumerate(limbs(x)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (LIMB * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of c, the first on ties; its squared distance) for each row of x."""
    d = (x * x).sum(axis=1)[:, None] - 2 * products(x, c) + (c * c).sum(axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of a list column as integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def assigned(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its integers, codes and distances. books: (parts, entries, width)."""
    for p, c in enumerate(books):
        own = x[:, p * c.shape[1] : (p + 1) * c.shape[1]]
        yield (own, *nearest(own, c))


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """Rows with a finite vector `v`, and whether it is `small` enough for sums in 64 bits."""
    v = F.col("embedding").cast("array<double>")
    finite = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where(finite)
    return rows.withColumn("small", F.forall("v", lambda x: F.abs(x) <= F.lit(RANGE / scale)))


def totals(vectors: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """(part, entry, n, sums) over all vectors, assigned to their nearest entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for p, (own, at, _) in enumerate(assigned(integers(batch["v"].slice(k, ROWS), scale), books)):
                    n[p] += np.bincount(at, minlength=entries)
                    np.add.at(sums[p], at, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": p, "entry": e, "n": n[p, e], "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))})

    own = vectors.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    return own.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))


def learn_codebooks(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width) after `rounds` rounds. vectors: vec_id, v, all of one length."""
    first = [r.v for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    flat = np.floor(np.array(first, np.float64) * scale).astype(np.int64)
    if flat.shape[1] % parts:
        raise ValueError(f"{parts} parts don't divide vectors of length {flat.shape[1]}")
    books = np.ascontiguousarray(flat.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        for r in totals(vectors, books, scale).collect():  # parts x entries rows at most
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error of vectors (vec_id, label, v, small)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                small = part["small"].to_numpy(zero_copy_only=False)
                codes, error = [None] * part.num_rows, np.zeros(part.num_rows, np.int64)
                if small.any():
                    found = list(assigned(integers(part["v"].filter(part["small"]), scale), books))
                    error[small] = sum(d for _, _, d in found)
                    for i, row in zip(np.flatnonzero(small).tolist(), np.stack([at for _, at, _ in found], axis=1).astype(np.uint8)):
                        codes[i] = row.tobytes().hex()
                yield beside(part, ["vec_id", "label"], code=pa.array(codes, pa.string()), error=pa.array(error, mask=~small))

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v", "small").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows (label, error, ...) and `label_error`, the sum over all rows of the same label. Labels of more than a thousandth of the rows,
    of which there are at most a thousand, are broadcast; the others join by sort and merge, each at most a thousandth of the rows."""
    sums = durable(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")).withColumnRenamed("label", "_label"), "label-errors")
    bound = rows.count() / 1000
    hot, cold = F.broadcast(sums.where(F.col("_n") > bound)), sums.where(F.col("_n") <= bound)
    same = F.col("label").eqNullSafe(F.col("_label"))
    often = rows.join(hot, same)
    seldom = rows.join(hot, same, "left_anti").join(cold.hint("merge"), same)
    return often.unionByName(seldom).drop("_label", "_n")


def vector_codes(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of rows (vec_id, embedding, label)."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    own = usable(rows, scale)
    head = own.where("small").orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).collect()
    if not head:
        none = own.select("vec_id", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")])
        return none.withColumn("codebooks_sha256", F.sha2(F.lit(""), 256))
    own = own.where(F.size("v") == head[0].n)
    books = learn_codebooks(own.where("small"), parts=parts, entries=entries, rounds=rounds, scale=scale)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = with_label_error(durable(encode(own, books, scale), "vector-codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, part, min(d * {ENTRIES} + entry) AS m FROM (SELECT x.r, x.part, c.entry, sum((x.q - c.q) * (x.q - c.q))::BIGINT AS d
    FROM x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} AS (SELECT x.part, a.m % {ENTRIES} AS entry, x.pos, sum(x.q)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} a ON a.r = x.r AND a.part = x.part GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.q) AS q
    FROM c{k} c LEFT JOIN s{k} s ON s.part = c.part AND s.entry = c.entry AND s.pos = c.pos)""")
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT r, v, unnest(range(len(v))) AS i, len(v) // {PARTS} AS w FROM e),
x AS MATERIALIZED (SELECT r, i // w AS part, i % w AS pos, floor({SCALE} * v[i + 1])::BIGINT AS q FROM i),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, q FROM x WHERE r <= {ENTRIES}),{",".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT e.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY e.label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256 FROM e JOIN o ON o.r = e.r
"""


OP13_SQL = _sql()
