"""The n-gram model against a dictionary of dictionaries in plain Python, for several orders, and its probabilities' sums."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from subseqrules.llm import ngram_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, n_tokens string, level int, bucket int"
END, START = "</s>", "<s>"


def words(t):
    return [*WORD.findall((t or "").translate(LOWER)), END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Slow:
    """Modified Kneser-Ney by its definition; grams are tuples."""

    def __init__(self, texts, order):
        self.order = order
        grams = [Counter() for _ in range(order + 1)]
        self.raw = Counter()
        for t in texts:
            own = [START, *words(t)]
            self.raw.update(own[1:])
            for n in range(1, order + 1):
                for k in range(len(own) - n + 1):
                    if own[k : k + n] != [START]:
                        grams[n][tuple(own[k : k + n])] += 1
        self.a = [None] * (order + 1)
        self.a[order] = grams[order]
        for n in range(order - 1, 0, -1):
            self.a[n] = Counter({g: c for g, c in grams[n].items() if g[0] == START})
            self.a[n].update(Counter(g[1:] for g in grams[n + 1]))
        self.d = [[0, 0.5, 1.0, 1.5] for _ in range(order + 1)]
        self.follow = [defaultdict(dict) for _ in range(order + 1)]  # of a context the words after it
        for n in range(1, order + 1):
            c = Counter(self.a[n].values())
            if c[1] and c[2] and c[3]:
                y = c[1] / (c[1] + 2 * c[2])
                own = [k - (k + 1) * y * c[k + 1] / c[k] for k in (1, 2, 3)]
                if all(0 < x <= k for k, x in enumerate(own, 1)):
                    self.d[n] = [0, *own]
            for g, x in self.a[n].items():
                self.follow[n][g[:-1]][g[-1]] = x
        self.left = [{h: (sum(f.values()), sum(self.d[n][min(x, 3)] for x in f.values())) for h, f in self.follow[n].items()} for n in range(order + 1)]

    def p(self, w, context):
        n = len(context) + 1
        lower = self.p(w, context[1:]) if context else 1 / (len(self.raw) + 1)
        follow = self.follow[n].get(context)
        if not follow:
            return lower
        total, left = self.left[n][context]
        x = follow.get(w, 0)
        return max(x - self.d[n][min(x, 3)], 0) / total + left / total * lower

    def score(self, text):
        own = [START, *words(text)]
        return sum(math.log10(self.p(own[k], tuple(own[max(0, k - self.order + 1) : k]))) for k in range(1, len(own)))


def texts(n, seed):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Ab", "x y", "漢字"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    return [("\t" if k % 5 == 0 else "") + "  \n".join(r.choice(vocabulary, int(r.integers(1, 40)), p=p / p.sum())) + (" " if k % 3 else "") for k in range(n)]


ROWS = [*enumerate(texts(120, 1)), (500, None), (501, ""), (502, " \t "), (None, "w1 w2 W3"), (3, "again w1"), (3, "again w1"), (-7, "unseen-word only-here"), (2**62, "ab AB aB"), (503, "w1 w2 " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_definition(spark, order):
    train = [t for i, t in ROWS if not held(i)]
    slow = Slow(train, order)
    n, v = sum(slow.raw.values()), len(slow.raw)
    got = sorted(lm.language_scores(frame(spark, ROWS), order).collect(), key=lambda r: (str(r.doc_id), r.score))
    want = []
    for i, t in ROWS:
        own = words(t)
        want.append((i, held(i), len(own), sum(w in slow.raw for w in own), n, sum(math.log10((slow.raw[w] + 1) / (n + v + 1)) for w in own), slow.score(t)))
    want.sort(key=lambda r: (str(r[0]), r[-1]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([tuple(r)[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    assert any(r.held_out for r in got)


def test_blocks_leave_early(monkeypatch):
    monkeypatch.setattr(lm, "PENDING", 50)
    tally, blobs = lm.Tally(2, 3, 2), []
    ids = np.random.default_rng(2).integers(0, 30, (2, 4000)).astype(np.uint64)
    for k in range(0, 4000, 40):
        blobs += tally.add([ids[0, k : k + 40], ids[1, k : k + 40]], np.ones(40, np.int64))
    blobs += tally.merge(-1)
    total = Counter()
    for r in blobs:
        (a, b), (n,) = lm.opened(r["blob"], 2)
        assert (lm.bucket_of(lm.gram_keys([a, b]), 3) == r["bucket"]).all()
        for x, y, c in zip(a.tolist(), b.tolist(), n.tolist()):
            total[x, y] += c
    assert total == Counter(zip(ids[0].tolist(), ids[1].tolist()))


def test_partitions_do_not_matter(spark):
    a, b = (sorted((str(r.doc_id), round(r.score, 9)) for r in lm.language_scores(frame(spark, ROWS).repartition(n), 2).collect()) for n in (1, 9))
    assert a == b


def test_no_rows_and_no_training(spark):
    assert lm.language_scores(frame(spark, ROWS).limit(0)).count() == 0
    only = [(i, "some words") for i in range(60) if held(i)]
    for r in lm.language_scores(frame(spark, only)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_blocks():
    r = np.random.default_rng(4)
    columns = [r.integers(0, 2**k, 100).astype(np.uint64) for k in (1, 8, 20, 40, 63)]
    assert all((a == b).all() for a, b in zip(lm.unpack(lm.pack(*columns)), columns))
    assert [len(c) for c in lm.unpack(lm.pack(*(c[:0] for c in columns)))] == [0] * 5


def test_query(spark, sf):
    """Whole table: exact counts, and a better model of held-out texts than single words."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm.op11_language_model(spark, sf).collect()}
    slow = Slow([t for i, t in docs if not held(i)], 2)
    n, v = sum(slow.raw.values()), len(slow.raw)
    assert len(got) == len(docs)
    for i, t in docs:
        own, r = words(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(w in slow.raw for w in own), n, held(i))
        assert r.base_score == pytest.approx(sum(math.log10((slow.raw[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        if len(own) < 200:
            assert r.score == pytest.approx(slow.score(t), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
