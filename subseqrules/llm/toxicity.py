"""Toxicity by a linear-chain conditional random field.

Labels are of documents. A word or word beginning (the first 5 or 4 letters) is evidence if the documents labelled toxic
have it far more often; tokens of toxic documents with evidence get label 1, all other tokens 0, and these labelled tokens
train the chain: two states, weights for the evidence of a token, a bias and the four transitions, fitted by quasi-Newton
steps on the likelihood of every token of every fitted row. A document's marginals are then summed up: the expected number of
toxic tokens, its density and the largest marginal are the inputs of a logistic score; tokens with a marginal of a half or
more are the offending spans.

Tokens without evidence all emit the same, so only tokens with evidence are visited: the run of plain tokens between two
of them is a power of one 2x2 matrix, by its two eigenvalues. That is exact, and a text costs what its evidence costs.

It is fitted on at most FIT_ROWS labelled rows (a parameter; those with the smallest hash of doc_id) and at most `keys`
words and beginnings (a parameter; those in most toxic rows). Of these rows the positions of evidence come to the driver, at most
FIT_TOKENS in all (a parameter; a row that would go beyond it is not fitted), whole texts do not; scores cover all rows. Defined results: null and empty texts and texts without words get the score of no evidence; equal texts get equal
scores; rows with equal or null ids a row each, ids as they are; labels with a null id or a null label are not used, nor are
texts with a null id in fitting; extra columns are ignored; without any labelled row, or with labels of one kind only, all scores are that
share of toxic rows (0 without rows).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, read_table, takes_over, text_slices, values

FIT_ROWS, FIT_TOKENS, THRESHOLD, STEPS = 12_000, 1 << 20, 0.3, 40
WORDS = re.compile(r"[^\W\d_]+")


def keys_of(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "*" for k in (5, 4) if len(word) >= k))


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)  # evidence of a word or a beginning
    chain: np.ndarray = field(default_factory=lambda: np.zeros(5))  # bias of state 1, scale of evidence, 0->1, 1->0, 1->1
    score: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))
    memo: dict[str, float] = field(default_factory=dict)

    def evidence(self, word: str) -> float:
        x = self.memo.get(word)
        if x is None:
            if len(self.memo) > 1 << 18:
                self.memo.clear()
            x = self.memo[word] = max((self.weights.get(k, 0.0) for k in keys_of(word.lower())), default=0.0)
        return x

    def active(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions of tokens with evidence, the evidence, number of tokens)."""
        words = WORDS.findall(text or "")
        get, evidence = self.memo.get, self.evidence
        x = [e if (e := get(w)) is not None else evidence(w) for w in words]
        at = [i for i, e in enumerate(x) if e]
        return np.array(at, np.int64), np.array([x[i] for i in at]), len(words)

    def marginals(self, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """P(token is toxic) of the tokens with evidence, by forward-backward over them and powers of the plain step: of the largest
        eigenvalue's share one, of the other's share its ratio to that, to the power of the plain tokens between."""
        if not len(at):
            return np.zeros(0)
        bias, scale, up, down, stay = self.chain.tolist()
        move = np.array([[1.0, np.exp(up)], [np.exp(down), np.exp(stay)]])
        values, vectors = np.linalg.eig(move * np.array([1.0, np.exp(bias)])[None, :])
        order = np.argsort(-np.abs(values))
        shares = [np.outer(vectors[:, k], np.linalg.inv(vectors)[k]) for k in order]
        (p00, p01), (p10, p11) = shares[0].tolist()
        (q00, q01), (q10, q11) = shares[1].tolist()
        (m00, m01), (m10, m11) = move.tolist()
        ratio = float(values[order[1]] / values[order[0]])
        gaps = (ratio ** (np.diff(at, prepend=-1) - 1).astype(float)).tolist()
        emit = np.exp(np.clip(bias + scale * x, -30, 30)).tolist()
        ahead, s0, s1 = [], 1.0, 0.0  # before the text: plain
        for r, e in zip(gaps, emit):
            a, b = s0 * (p00 + r * q00) + s1 * (p10 + r * q10), s0 * (p01 + r * q01) + s1 * (p11 + r * q11)
            s0, s1 = a * m00 + b * m10, (a * m01 + b * m11) * e
            total = s0 + s1
            s0, s1 = s0 / total, s1 / total
            ahead.append((s0, s1))
        r, out = ratio ** float(n - 1 - int(at[-1])), []
        a0, a1 = p00 + p01 + r * (q00 + q01), p10 + p11 + r * (q10 + q11)
        for (f0, f1), r, e in zip(reversed(ahead), reversed(gaps), reversed(emit)):
            out.append(f1 * a1 / (f0 * a0 + f1 * a1))
            b0, b1 = m00 * a0 + m01 * e * a1, m10 * a0 + m11 * e * a1
            a0, a1 = (p00 + r * q00) * b0 + (p01 + r * q01) * b1, (p10 + r * q10) * b0 + (p11 + r * q11) * b1
            total = a0 + a1
            a0, a1 = a0 / total, a1 / total
        return np.clip(np.array(out[::-1]), 0, 1)

    def features(self, m: np.ndarray, n: int) -> np.ndarray:
        return np.array([1.0, np.log1p(m.sum()), m.max(initial=0.0), 100 * m.sum() / max(50, n)])

    def score_from(self, m: np.ndarray, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(m, n) @ self.score, -30, 30))))

    def score_of(self, at, x, n) -> float:
        return self.score_from(self.marginals(at, x, n), n)

    def judge(self, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int]]]:
        """(score, (start, end) characters of the offending tokens), from one forward-backward."""
        at, x, n = self.active(text)
        m = self.marginals(at, x, n)
        bad = set(at[m >= least].tolist())
        return self.score_from(m, n), [w.span() for i, w in enumerate(WORDS.finditer(text or "")) if i in bad] if bad else []


@dataclass
class TokenRows:
    """Labelled token rows end to end; plain tokens are known by their number only."""

    gap: np.ndarray  # of an evidence token: plain tokens between it and the one before it
    x: np.ndarray  # its evidence
    row: np.ndarray  # its row, in rising order
    toxic: np.ndarray  # whether its label is 1; all plain tokens have 0
    rest: np.ndarray  # of a row: plain tokens after its last evidence token

    @classmethod
    def of(cls, tokens: list[tuple[np.ndarray, np.ndarray, int]], toxic: np.ndarray) -> TokenRows:
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        gap = flat((np.diff(at, prepend=-1) - 1 for at, _, _ in tokens), float)
        row = np.repeat(np.arange(len(tokens)), [len(at) for at, _, _ in tokens])
        rest = np.array([n - 1 - at[-1] if len(at) else n for at, _, n in tokens], float)
        return cls(gap, flat((x for _, x, _ in tokens), float), row, np.asarray(toxic, bool)[row], rest)

    def size(self) -> float:
        return len(self.x) + self.gap.sum() + self.rest.sum()

    def products(self, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first row of the product of each row's steps over its largest entry, log of that). A step is a 2x2 matrix, its entries in four
        arrays. Neighbours are multiplied again and again, so a row of n steps takes log n rounds over all rows at once."""
        out, logs = np.tile([1.0, 0.0], (len(self.rest), 1)), np.zeros(len(self.rest))
        row, scale = self.row, np.zeros(len(self.row))
        while len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            if len(first) == len(row):
                out[row], logs[row] = np.stack(steps[:2], axis=1), scale
                break
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            even = np.flatnonzero(place % 2 == 0)
            single = np.append(row[1:] != row[:-1], True)[even]  # no neighbour left in its row
            (a, b, c, d), (e, f, g, h) = ([x[k] for x in steps] for k in (even, np.minimum(even + 1, len(row) - 1)))
            both = (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h)
            steps = [np.where(single, x, y) for x, y in zip((a, b, c, d), both)]
            scale, row = scale[even] + np.where(single, 0.0, scale[np.minimum(even + 1, len(row) - 1)]), row[even]
            top = np.maximum.reduce(steps)
            steps, scale = [x / top for x in steps], scale + np.log(top)
        return out, logs

    def likelihood(self, chain: np.ndarray) -> float:
        """Log likelihood of the labels of all tokens of all rows."""
        bias, scale, up, down, stay = chain
        move = np.array([[1.0, np.exp(up)], [np.exp(down), np.exp(stay)]])
        values, vectors = np.linalg.eig(move * np.array([1.0, np.exp(bias)])[None, :])
        inverse, top = np.linalg.inv(vectors), np.abs(values).max()
        ratio, deep = values / top, np.log(top)
        emit, powers, right = np.exp(bias + scale * self.x), [r**self.gap for r in ratio], inverse @ move
        entry = lambda i, j: vectors[i, 0] * right[0, j] * powers[0] + vectors[i, 1] * right[1, j] * powers[1]
        whole, logs = self.products([entry(0, 0), entry(0, 1) * emit, entry(1, 0), entry(1, 1) * emit])
        after = ((vectors[None] * (ratio[None, :] ** self.rest[:, None])[:, None, :]) @ inverse).sum(axis=2)
        z = np.log((whole * after).sum(axis=1)).sum() + logs.sum() + deep * (self.rest.sum() + self.gap.sum())  # before the text: plain
        inside = np.concatenate(([False], self.row[1:] == self.row[:-1]))[: len(self.row)] & (self.gap == 0)
        follows = self.toxic & inside  # right after an evidence token; the first token of a row comes after plain
        last = np.concatenate((self.row[1:] != self.row[:-1], [True]))[: len(self.row)]
        leaves = self.toxic & ~np.concatenate((inside[1:], [False]))[: len(self.row)] & (~last | (self.rest[self.row] > 0))
        gold = (self.toxic * (bias + scale * self.x)).sum() + up * (self.toxic & ~follows).sum() + stay * follows.sum() + down * leaves.sum()
        return float(gold - z)


def fit_chain(rows: TokenRows, steps: int) -> np.ndarray:
    """Quasi-Newton steps on the mean log likelihood of a token, with a small pull to zero."""
    n = max(1.0, rows.size())

    def loss(c: np.ndarray) -> float:
        return -rows.likelihood(c) / n + 0.5e-6 * c @ c

    def slope(c: np.ndarray) -> np.ndarray:
        return np.array([loss(c + d) - loss(c - d) for d in np.eye(5) * 1e-4]) / 2e-4

    c, inverse = np.array([-3.0, 1.0, 0.0, 0.0, 0.0]), np.eye(5)
    now, g = loss(c), slope(c)
    for _ in range(steps):
        move, width = -inverse @ g, 1.0
        if move @ g >= 0:
            move, inverse = -g, np.eye(5)
        move = np.clip(move, -2, 2)
        while not (after := loss(np.clip(c + width * move, -20, 20))) < now and width > 1e-6:
            width /= 2
        new = np.clip(c + width * move, -20, 20)
        if not after < now or now - after < 1e-12:
            break
        s, y = new - c, (h := slope(new)) - g
        if (sy := s @ y) > 1e-14:
            a = np.eye(5) - np.outer(s, y) / sy
            inverse = a @ inverse @ a.T + np.outer(s, s) / sy
        c, now, g = new, after, h
    return c


def fit_logistic(f: np.ndarray, y: np.ndarray, pull: float = 1e-2) -> np.ndarray:
    """Newton steps with a small pull to zero."""
    w = np.zeros(f.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        h = (f * (p * (1 - p))[:, None]).T @ f + pull * np.eye(len(w))
        w = w + np.linalg.solve(h, f.T @ (y - p) - pull * w)
    return w


def held_out(doc_id):
    """crc32 of the id as text leaves remainder 2 by 4: never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` labelled rows with their texts, the smallest by a hash of the id; none that is held out."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    own = own.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most `rows` pairs of numbers


def keyed(rows: DataFrame) -> DataFrame:
    """Distinct (doc_id, toxic, key) of the words and beginnings of the training texts."""

    def run(batches):
        takes_over("toxicity")
        for pdf in batches:
            for i, t, y in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]):
                found = sorted({k for w in {*WORDS.findall((t or "").lower())} for k in keys_of(w)})
                yield pd.DataFrame({"toxic": y, "key": found})

    return rows.mapInPandas(run, "toxic int, key string")


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, tokens: int = FIT_TOKENS, least_docs: int = 3, lift: float = 5.0, keys: int = 4096, steps: int = STEPS) -> ToxicModel:
    """Learn evidence, chain and score from labelled rows."""
    train = durable(training_rows(docs, labels, rows), "toxic-train")
    counts = {int(r.toxic > 0): r.n for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return ToxicModel(score=np.array([30.0 if pos else -30.0, 0, 0, 0]))
    table = keyed(train.select("doc_id", "text", "toxic")).groupBy("key").agg(F.sum((F.col("toxic") > 0).cast("long")).alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1.0))
    strong = (F.col("p") >= least_docs) & (F.col("p") / F.col("n") > 0.75) & (odds > np.log(lift) + np.log1p(1 / pos))
    found = table.where(strong).select("key", odds.alias("w"), "p").orderBy(F.desc("p"), "key").limit(keys).collect()
    model = ToxicModel({r.key: float(r.w) for r in found})

    def run(batches):
        for pdf in batches:
            out = [model.active(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "at": [a for a, _, _ in out], "x": [x for _, x, _ in out], "n": [n for _, _, n in out]})

    data = train.select("doc_id", "toxic", "text").mapInPandas(run, "doc_id long, toxic int, at array<long>, x array<double>, n long")
    data = durable(data.withColumn("r", F.monotonically_increasing_id()), "toxic-evidence")
    order, used, chosen = ["doc_id", "toxic", "n", "evidence"], 0, []
    sizes = data.select("r", "doc_id", "toxic", "n", F.size("at").alias("evidence")).orderBy(F.xxhash64("doc_id"), *order).limit(rows).collect()
    for r in sizes:  # a row that would go beyond the bound is left out as a whole
        if used + r.evidence <= tokens:
            used += r.evidence
            chosen.append((r.r,))
    picked = docs.sparkSession.createDataFrame(chosen, "r long")
    data = data.join(F.broadcast(picked), "r").toPandas()  # at most `rows` rows and `tokens` positions
    data = data.sort_values(["doc_id", "toxic", "n", "r"], kind="stable").reset_index(drop=True)
    y = (data["toxic"] > 0).to_numpy(float)
    own = [(np.asarray(a, int), np.asarray(x, float), n) for a, x, n in zip(data["at"], data["x"], data["n"])]
    model.chain = fit_chain(TokenRows.of(own, y), steps)
    f = np.array([model.features(model.marginals(*t), t[2]) for t in own])
    model.score = fit_logistic(f, y)
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, offending (array of start, end) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: at most `keys` weights

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("toxicity")
        m = shared.value
        for batch in chain.from_iterable(map(text_slices, batches)):
            rows = [m.judge(t) for t in values(batch["text"])]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in rows], kind)
            yield beside(batch, ["doc_id"], score=np.array([x for x, _ in rows], float), offending=spans)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, score double, offending array<struct<start: int, end: int>>")


def reject(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        takes_over("toxicity")
        m = shared.value
        for batch in chain.from_iterable(map(text_slices, batches)):
            yield batch.filter(pa.array([m.score_of(*m.active(t)) < threshold for t in values(batch["text"])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
