"""The near_duplicates stage against all pairs of exact similarities."""

import numpy as np
import pytest

from subseqrules.llm import simhash

from .test_ops import WORD, groups

R = np.random.default_rng(5)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return ["".join(R.choice(list("abcdefgh"), R.integers(2, 6))) for _ in range(n)]


def brute_similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (WORD.findall((t or "").lower()) for t in (a, b)))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(base, edits):
    out = list(base)
    for k in R.choice(len(out), edits, replace=False):
        out[k] = words(1)[0] + "x"
    return " ".join(out)


def test_every_similar_pair_is_joined_and_no_other(spark):
    pytest.importorskip("xxhash")
    import corpus_pipeline as pipeline

    rows, base = [], words(150)
    for k in range(60):  # pairs below, at and over the threshold
        own = words(int(R.integers(40, 200)))
        rows += [(2 * k, " ".join(own), "en", "s", 0), (2 * k + 1, edited(own, 1 + k % 5), "en", "s", 0)]
    rows += [(500 + k, edited(base, int(R.integers(1, 6))), "en", "s", 0) for k in range(80)]
    rows += [(600, "One two three", "en", "s", 0), (601, "one  TWO three", "en", "s", 0), (602, "one two", "en", "s", 0), (603, "", "en", "s", 0), (604, None, "en", "s", 0)]
    top = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if brute_similarity(rows[i][1], rows[j][1]) >= 0.8])
    far = [(i, i + 1) for i in range(0, 120, 2) if brute_similarity(rows[i][1], rows[i + 1][1]) >= 0.8]
    assert any((simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > simhash.RADIUS for i, j in far)
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted({rows[k][0] for k in top})
    assert pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
