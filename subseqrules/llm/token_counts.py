"""Token counts as delta-maintained rollups.

State is a folder of committed batches. A batch is a set of signed changes (+1 insert, -1 delete; a revised count is a
delete of the old and an insert of the new), summed by (source, lang, tokenizer version) before it is written, so the
state grows with batches times groups, never with documents. Totals are additive: the sum over committed batches.

A commit is idempotent. A batch is written as one Parquet folder named by a hash of its id; then a mark, a table of one row, is
written, and only with its mark a batch counts. A batch with a mark is not applied again; one without is what a lost job
left, and is overwritten. `compact` writes the sum of batches as a new batch whose mark names them: from then on they count
through it only, and as their marks stay, a replay of one of them is without effect.

Defined results: null texts count 0 tokens and 1 document; null source or lang is a group of its own; an empty change set
commits an empty batch; groups whose documents all went stay with zero totals; null and repeated doc_ids count a row each;
extra columns are ignored; batches that are named but not committed count nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch_path, word_count

KEYS = ("source", "lang", "tokenizer")


MARK, STATE = "batch string, folded array<string>", "source string, lang string, tokenizer string, docs long, tokens long"


def place(batch: str) -> str:
    """The folder name of a batch: ids may hold any characters, paths not."""
    return hashlib.sha256(batch.encode()).hexdigest()


def marks(spark: SparkSession, folder: str, batch: str | None = None) -> list:
    """The marks (batch, folded) of committed batches, or of one, one small row for each."""
    try:
        return spark.read.schema(MARK).parquet(f"{folder}/marks/{'*' if batch is None else place(batch)}").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []  # nothing is committed


def changes(docs: DataFrame, tokenizer: str, tokens, sign: int = 1) -> DataFrame:
    """Signed change rows for each document under a tokenizer version; tokens is a column."""
    n = F.coalesce(tokens.cast("long"), F.lit(0))
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (n * sign).alias("tokens"))


def commit(folder: str, batch: str, delta: DataFrame, folded: list[str] | None = None) -> bool:
    """Apply a batch once; False if it was there already."""
    spark = delta.sparkSession
    if marks(spark, folder, batch):
        return False
    sums = delta.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    sums.write.mode("overwrite").parquet(f"{folder}/batches/{place(batch)}")
    spark.createDataFrame([(batch, folded or [])], MARK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/{place(batch)}")
    return True


def totals(spark: SparkSession, folder: str, batches: list[str] | None = None) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) over the committed batches, or over those of them that are named. A batch folded
    into another that counts too counts once."""
    named = [r for r in marks(spark, folder) if batches is None or r.batch in batches]
    within = {b for r in named for b in r.folded}
    here = [f"{folder}/batches/{place(r.batch)}" for r in named if r.batch not in within]
    rows = spark.read.schema(STATE).parquet(*here) if here else spark.createDataFrame([], STATE)
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def compact(spark: SparkSession, folder: str, batches: list[str], into: str) -> DataFrame:
    """Write the sum of the batches as the batch `into`, which stands for them from then on."""
    inner = [b for r in marks(spark, folder) if r.batch in batches for b in r.folded]
    commit(folder, into, totals(spark, folder, batches), sorted({*batches, *inner}))
    return totals(spark, folder, [into])


def op10_token_counts(spark, sf_dir):
    """Three batches over all documents, the second sent twice: word counts are inserted; character counts are inserted as
    the table declares them (n_chars); these are then revised to what the texts hold."""
    docs, folder = read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-counts")
    said, real = F.col("n_chars"), F.char_length("text")
    commit(folder, "0001-words", changes(docs, "words-1", word_count("text")))
    commit(folder, "0002-chars", changes(docs, "chars-1", said))
    commit(folder, "0002-chars", changes(docs, "chars-1", said))
    commit(folder, "0003-revised", changes(docs, "chars-1", said, -1).unionAll(changes(docs, "chars-2", real)))
    return totals(spark, folder)


OP10_SQL = """
WITH d AS (SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS w,
                  coalesce(n_chars, 0)::BIGINT AS n, coalesce(length(text), 0)::BIGINT AS r FROM documents),
c AS (SELECT source, lang, 'words-1' AS tokenizer, 1 AS s, w AS t FROM d UNION ALL SELECT source, lang, 'chars-1', 1, n FROM d
      UNION ALL SELECT source, lang, 'chars-1', -1, -n FROM d UNION ALL SELECT source, lang, 'chars-2', 1, r FROM d)
SELECT source, lang, tokenizer, sum(s)::BIGINT AS docs, sum(t)::BIGINT AS tokens FROM c GROUP BY ALL
"""
