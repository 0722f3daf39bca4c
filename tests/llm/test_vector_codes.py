"""Product codes against k-means in Python integers, limb products against Python's, and odd rows."""

import hashlib

import numpy as np
import pytest

from subseqrules.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label string, v long, code long, error string, small long, _label long"
R = np.random.default_rng(5)


def rows_of(vectors):
    return [(i, v, g, 1, 2, "clash", 3, 4) for i, v, g in vectors]


def slow(vectors, parts=8, entries=16, rounds=6):
    """Python integers only; keyed by place in the list."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], g) for i, v, g in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(order[0][1]) // parts
    cut = lambda q: [q[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(q)[p] for _, q, _ in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda part, p: min((dist(part, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, q, _ in kept:
                groups.setdefault(pick(cut(q)[p], p)[1], []).append(cut(q)[p])
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])])
        books = new
    got = [(i, [pick(cut(q)[p], p) for p in range(parts)], g) for i, q, g in kept]
    sums = {}
    for _, found, g in got:
        sums[g] = sums.get(g, 0) + sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), sums[g], digest) for i, found, g in got]


def check(spark, vectors, **how):
    got = vc.vector_codes(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3), **how).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow(vectors, **how), key=str)


def test_against_python(spark):
    vectors = [(int(k), R.normal(0, 0.3, 16).tolist(), f"g{k % 3}" if k % 5 else None) for k in R.permutation(70)]
    vectors += [(3, vectors[3][1], "g1"), (3, vectors[3][1], "g1"), (None, R.normal(0, 1, 16).tolist(), "only"), (2**62 + 1, [0.0] * 16, None)]
    odd = [(80, None, "g1"), (81, [], "g1"), (82, [float("nan")] + [0.0] * 15, "g1"), (83, [None] + [0.0] * 15, "g1"), (84, [float("inf")] * 16, None)]
    check(spark, vectors + odd)


def test_ties_and_few_rows(spark):
    check(spark, [(k, [float(k // 2 % 2)] * 8, "a") for k in range(40)])  # equal entries: the first takes all, others stay
    check(spark, [(k, R.normal(0, 1, 8).tolist(), "a") for k in range(5)])
    check(spark, [(k, R.normal(0, 1, 12).tolist(), "a") for k in range(30)], parts=4, entries=3, rounds=2)


def test_wide_components(spark):
    check(spark, [(k, R.normal(0, 4000, 16).tolist(), "a") for k in range(40)])  # up to 2^26: both limbs count
    rows = [(k, R.normal(0, 1, 8).tolist(), "a") for k in range(20)]
    got = {r.vec_id: r for r in vc.vector_codes(spark.createDataFrame(rows_of([*rows, (99, [1e300] + [0.0] * 7, "a"), (98, [0.0] * 9, "a")]), SCHEMA)).collect()}
    assert set(got) == {*range(20), 99} and got[99].code is None and got[99].error is None
    assert [tuple(got[k]) for k in range(20)] == slow(rows)


def test_limbs():
    x, c = R.integers(-(2**26), 2**26, (40, 9)), R.integers(-(2**26), 2**26, (7, 9))
    x[0], c[0] = 2**26, -(2**26)
    assert vc.products(x, c).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in c] for p in x]


def test_empty_and_errors(spark):
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vc.vector_codes(spark.createDataFrame(rows_of([(1, [1.0] * 9, "a")]), SCHEMA))


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(vc.OP13_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, vc.op13_vector_codes(spark, sf).select(*names).collect())) == sorted(want.fetchall())
