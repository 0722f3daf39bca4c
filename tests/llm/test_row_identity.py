"""Rows with null and repeated ids through the pipeline's stages."""

import pytest

from .test_near_copies import SCHEMA, words


def test_null_and_repeated_ids_stay(spark):
    pytest.importorskip("xxhash")
    import corpus_pipeline as pipeline
    from subseqrules.llm.common import durable
    from subseqrules.llm.mixing import mixed_documents

    a, b, c, d, e = (" ".join(words(60)) for _ in range(5))
    rows = [(None, a, "en", "s", 0), (None, b, "en", "s", 0), (1, c, "en", "s", 0), (7, d, "en", "s", 0), (7, e, "en", "s", 0), (7, c, "en", "s", 0), (None, d, "en", "s", 0)]
    one = durable(pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), ""), "near")
    kept = {(None, a), (None, b), (1, c), (7, d), (7, e)}
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == sorted(kept, key=str)
    cut = durable(pipeline.repeated_strings(spark, one, ""), "cut")
    assert {(r.doc_id, r.text) for r in cut.collect()} == kept
    mix = mixed_documents(cut, share=2)  # all of the source twice
    assert sorted(((r.doc_id, r.text) for r in mix.collect()), key=str) == sorted([*kept, *kept], key=str)
