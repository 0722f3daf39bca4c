"""Worker processes outlive a stage: what one operator remembers in them is gone while the next one works."""

import pyarrow as pa
from pyspark.sql import functions as F

from subseqrules.llm import bpe, common, near_copies


def test_memory_of_an_operator_goes_when_another_begins():
    gone = []
    common.takes_over("one", lambda: gone.append("one"))
    common.takes_over("one", lambda: gone.append("one"))
    assert not gone  # its own stays from task to task
    common.takes_over("two")
    common.takes_over("two", lambda: gone.append("two"))
    assert gone == ["one"]
    common.takes_over("three")
    assert gone == ["one", "two"]


def test_encoders_are_gone_from_workers_that_fingerprint(spark):
    import public_tokenizers as public

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).cast("long").alias("n_chars")).repartition(4)
    assert bpe.encode_documents(docs, public.path("byte_bpe_50k.json"), public.PATTERN).count() == 40
    assert near_copies.without_near_copies(docs).count() <= 40

    def held(batches):
        for batch in batches:
            n = [len(bpe._LOADED) and bool(near_copies.WORDS)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["both"])

    assert {r.both for r in docs.mapInArrow(held, "both long").collect()} == {0}
