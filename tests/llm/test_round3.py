"""Odd ids, clashing columns and long values in mixing, near copies, media and token counts."""

import time

from pyspark.sql import functions as F

from subseqrules.llm import media, mixing, near_copies, token_counts


def test_ids_of_one_pattern_are_spread(spark):
    for ids in (F.col("id") * 4096, F.lit(7)):
        docs = spark.range(40_000).select(ids.alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"), F.lit("s").alias("source"))
        n = mixing.mix_sources(docs, bucket_rows=1000).groupBy("bucket").agg(F.countDistinct("doc_id", "seq").alias("n")).collect()
        assert len(n) == 40 and max(r.n for r in n) < 1500


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(k, f"one two three four five six {k % 3} seven eight", "s", 7, f"row{k}", "w", "z") for k in range(30)], "doc_id long, text string, source string, n_chars long, row_ string, words_ string, size_ string")
    got = mixing.mixed_documents(docs).collect()
    assert got and all(r.row_ == f"row{r.doc_id}" and (r.words_, r.size_) == ("w", "z") for r in got)
    docs = docs.select("doc_id", "text", F.lit("mine").alias("r1"), F.lit("too").alias("r2"), F.lit("here").alias("own"))
    kept = near_copies.without_near_copies(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("mine", "too", "here")}


def test_many_false_beginnings():
    for magic in (b"%PDF-1 ", b"PK\x03\x04" + b"\0" * 40, b"\xff\xd8\xff\xda"):
        began = time.time()
        assert not media.media_in(magic * 200_000)
        assert time.time() - began < 20
    whole = b"%PDF-1.4 x startxref 9 %%EOF"
    assert media.media_in(b"--" + whole + b"%PDF-") == [("application/pdf", 2, len(whole))]


def test_declared_types_and_carving(spark, tmp_path):
    gif = b"GIF89a" + b"\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    docs = spark.createDataFrame([(1, "plain"), (2, "a %PDF-1.4 startxref 3 %%EOF b")], "doc_id long, text string")
    media.store_texts(docs, f"file://{tmp_path}/m")
    got = {r.doc_id: (r.declared, r.media_type, r.wrong_type, r.n_embedded) for r in media.media_features(spark.read.parquet(f"file://{tmp_path}/m")).collect()}
    assert got == {1: (media.OTHER, "audio/wav", True, 0), 2: (media.OTHER, "audio/wav", True, 1)}
    rows = spark.createDataFrame([("a", "image/png", bytearray(gif)), ("b", "image/gif", bytearray(gif + gif)), ("c", "text/plain", bytearray(b"no"))], "key string, said string, value binary")
    got = {r.key: r for r in media.sniff_media(rows, "key", "value", "said").collect()}
    assert [(got[k].media_type, got[k].wrong_type, got[k].n_media) for k in "abc"] == [("image/gif", True, 1), ("image/gif", False, 2), (media.OTHER, True, 0)]
    assert bytes(got["b"].media[1].bytes) == gif


def test_any_batch_id(spark, tmp_path):
    folder = f"file://{tmp_path}/counts"
    docs = spark.createDataFrame([("s", "en", "a b c")], "source string, lang string, text string")
    delta = token_counts.changes(docs, "words", F.lit(3))
    for batch in ("b[1]", "b1", "a/b", "*", "{x,y}", "ä ?%20"):
        assert token_counts.commit(folder, batch, delta) and not token_counts.commit(folder, batch, delta)
    assert [tuple(r) for r in token_counts.totals(spark, folder).collect()] == [("s", "en", "words", 6, 18)]
    assert [tuple(r) for r in token_counts.totals(spark, folder, ["b[1]"]).collect()] == [("s", "en", "words", 1, 3)]
