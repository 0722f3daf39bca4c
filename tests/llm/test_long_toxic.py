"""Very long texts in fitting and scoring toxicity."""

import time

import numpy as np
from pyspark.sql import functions as F

from subseqrules.llm import toxicity


def test_likelihood_of_a_long_row():
    """One row among many with very many evidence tokens costs what it holds, and counts as it does alone."""
    r = np.random.default_rng(3)
    short = [(np.sort(r.choice(60, 5, replace=False)), r.uniform(0, 4, 5), 60) for _ in range(3000)]
    long = (np.sort(r.choice(400_000, 100_000, replace=False)), r.uniform(0, 4, 100_000), 400_000)
    chain = np.array([-2.0, 0.7, -0.3, 0.4, 0.2])
    began = time.time()
    both = toxicity.TokenRows.of([*short, long], np.arange(3001) % 2 == 0).likelihood(chain)
    assert time.time() - began < 5
    apart = toxicity.TokenRows.of(short, np.arange(3000) % 2 == 0).likelihood(chain) + toxicity.TokenRows.of([long], np.array([True])).likelihood(chain)
    assert abs(both - apart) < 1e-6 * abs(both)


def test_fit_with_a_text_of_megabytes(spark):
    bad, good = ["vile", "wretch", "scum"], ["lake", "tree", "stone", "cloud", "river"]
    r = np.random.default_rng(5)
    line = lambda words, n: " ".join(r.choice(words, n))
    texts = [(i, line([*good, *(bad if i % 3 == 0 else [])], 30), int(i % 3 == 0)) for i in range(200)]
    long = next(i for i in range(10**6, 10**6 + 99) if not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0])
    texts.append((long, line([*good, *bad], 900_000), 1))
    assert len(texts[-1][1]) > 4_500_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, steps=12)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in texts)
    small = toxicity.fit(docs, labels, tokens=2000, steps=12)  # the long row doesn't fit in, the others do
    assert {i for i, x in ((x.doc_id, x.score) for x in toxicity.score(docs, small).collect()) if x >= toxicity.THRESHOLD} == {i for i, _, y in texts if y}


def test_held_out_texts(spark, sf):
    """Of the labelled rows that no fit has seen, few are called toxic wrongly, and most toxic ones found though few are there to learn from."""
    out = toxicity.op9_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(x.predicted == 1 and x.toxic == 1 for x in out)
    assert hit >= 0.6 * sum(x.toxic for x in out) and hit >= 0.85 * sum(x.predicted for x in out)
