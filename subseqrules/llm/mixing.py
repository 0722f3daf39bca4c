"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only.

Every source's documents are put in a shuffled order and cut into blocks of equal token counts. A schedule of N slots
visits the points i*g mod N, the golden-ratio sequence on an integer lattice (g is the integer nearest N/phi that is
coprime to N), and maps each point through the cumulative slot counts of the sources. As the lattice visits every point
once, each source gets exactly its number of slots, spread evenly. The r-th slot of a source takes its r-th block.

Prefix sums and ranks are taken in two levels (buckets of a source, then rows of a bucket), so a source that holds most
rows is spread over as many tasks as it has buckets. Buckets are ranges of a hash of id and text. The sources themselves, few by
nature, are ranked in one task.

Defined results: null or empty texts have size 0 and take nothing; a null source is a source of its own, after all
others; rows with equal ids keep one output row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, read_table, running_start, unused, word_count

WEIGHTS, SHARE, REPEATS, BLOCK, BUCKET_ROWS, CHUNK = (3, 1, 2), 1.5, 2, 1024, 4096, 8192


def golden_step(n: int) -> int:
    """The integer nearest n/phi, the smaller on ties, that is coprime to n."""
    at = round(n * (math.sqrt(5) - 1) / 2)
    return next(g for d in range(n + 1) for g in (at - d, at + d) if g >= 1 and math.gcd(g, n) == 1)


def source_targets(parts: DataFrame, *, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """A row for each source: sid (from 1), source_size, weight, target. parts has columns source and part_size.

    min(repeats * size, level * weight) summed over the sources equals share * all sizes; with sources sorted by
    repeats * size / weight, the level is the largest (rest of the total) / (rest of the weights)."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    src = src.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    by = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    src = src.withColumn("before", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("rest", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    src = src.withColumn("total", F.sum("source_size").over(every))
    src = src.withColumn("level", F.max((F.col("total") * F.lit(float(share)) - F.col("before")) / F.col("rest")).over(every))
    return src.select("source", "sid", "source_size", "weight", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, share=SHARE, repeats=REPEATS, block=BLOCK, bucket_rows=BUCKET_ROWS, carry=()) -> DataFrame:
    """The mix: a row for each piece of a document in the schedule, and one with null slot for a document left out.

    Columns: doc_id, source, size, source_size, target, bucket, seq (these two tell rows with equal ids apart), turn
    (0: first time through the source), slot (place in the mix), from_word, words, and those named in carry. A block has
    `block` words, more where the mix would have over 2^30 blocks, so that places fit 64 bits when they are multiplied."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    h = F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long")  # ids of any pattern, and equal ones, are spread
    base = durable(docs.select("doc_id", "source", word_count("text").alias("size"), h.alias("h"), *carry), "mix-sizes")
    n_docs, total = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(block, math.ceil(total * share / 2**30))
    buckets = max(1, -(-n_docs // bucket_rows))
    base = base.withColumn("bucket", F.shiftright(F.col("h") * buckets, 32))

    parts = durable(base.groupBy("source", "bucket").agg(F.sum("size").alias("part_size")), "mix-parts")
    src = source_targets(parts, weights=weights, share=share, repeats=repeats)
    src = src.withColumn("quota", F.floor("target")).withColumn("slots", F.ceil(F.col("quota") / block))
    src = durable(src.withColumn("first", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "mix-sources")
    n = src.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    parts = parts.join(src, parts.source.eqNullSafe(src.source)).drop(src.source)
    parts = running_start(parts, "sid", "bucket", "part_size", "part_start")
    same = base.source.eqNullSafe(parts.source) & (base.bucket == parts.bucket)
    docs = base.join(parts.hint("merge"), same).drop(parts.source).drop(parts.bucket)
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", *carry)
    docs = docs.withColumn("seq", F.row_number().over(within))
    docs = docs.withColumn("start", F.col("part_start") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    turns = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(repeats) - 1)), lambda k: F.struct(
        k.alias("turn"), (F.col("start") + k * F.col("source_size")).alias("at"),
        F.least(F.col("start") + F.col("size") + k * F.col("source_size"), F.col("quota")).alias("to")))
    pieces = docs.withColumn("p", F.explode_outer(F.filter(turns, lambda x: x["to"] > x["at"])))
    pieces = pieces.withColumn("rank", F.explode_outer(F.when(F.col("p").isNotNull(), F.sequence(F.floor(F.col("p.at") / block), F.floor((F.col("p.to") - 1) / block)))))
    lo = F.greatest(F.col("p.at"), F.col("rank") * block)
    pieces = pieces.select(
        "doc_id", "source", "size", "source_size", "target", "sid", "bucket", "seq", *carry, "rank", F.col("p.turn").alias("turn"),
        (lo - F.col("p.at")).alias("from_word"), (F.least(F.col("p.to"), (F.col("rank") + 1) * block) - lo).alias("words"))
    return pieces.join(schedule(src, n).hint("merge"), ["sid", "rank"], "left").drop("sid", "rank")


def schedule(src: DataFrame, n: int) -> DataFrame:
    """(sid, rank, slot) for the n slots that src (sid, first, slots) shares out."""
    n = max(1, n)
    back = pow(golden_step(n), -1, n) if n > 1 else 0
    runs = src.where("slots > 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK))))
    runs = runs.repartition(max(1, min(4096, n // CHUNK + 1)))
    slots = runs.withColumn("j", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("slots"), (F.col("c") + 1) * CHUNK) - 1)))
    slots = slots.select("sid", ((F.col("first") + F.col("j")) * back % n).alias("slot")).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    before = running_start(slots.groupBy("sid", "chunk").agg(F.count("*").alias("k")), "sid", "chunk", "k", "ahead")
    slots = slots.join(before.drop("k").hint("merge"), ["sid", "chunk"])  # sizes are guessed from the sources: it would be broadcast
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1 + F.col("ahead")
    return slots.select("sid", "slot", rank.alias("rank"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with the columns they have: a row for each turn a document is taken in, its text cut after
    the words taken where the source's target ends inside it. docs has columns doc_id, text, source, n_chars; rows with null or equal ids are rows of their own."""
    columns = docs.columns
    row, words, size = (unused(c, columns) for c in ("row_", "words_", "size_"))
    docs = durable(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")  # written: the numbers stay
    mix = mix_sources(docs, carry=[row], **how).where("slot is not null")
    taken = mix.groupBy(row, "turn").agg(F.sum("words").alias(words), F.max("size").alias(size)).drop("turn")
    out = docs.join(taken, row)
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each a word and the white space behind it
    lead = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    first = F.array_join(F.slice(pieces, 1, F.col(words).cast("int") + lead), "")
    out = out.withColumn("text", F.when(F.col(words) < F.col(size), first).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def op1_mixing(spark, sf_dir):
    mix = mix_sources(read_table(spark, sf_dir, "documents"))
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0))
    return mix.groupBy("doc_id", "source", "size", "source_size", "target", "bucket", "seq").agg(taken.alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(most, max(lv) OVER () * weight) AS target FROM v),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + size + source_size, quota) - start - source_size))::BIGINT AS taken FROM o
"""
