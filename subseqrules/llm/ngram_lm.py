"""Language-model scoring: interpolated modified Kneser-Ney n-grams, counted in Spark and looked up in sorted hash arrays.

Words are known by their 64-bit XXH3 hash; the training words, sorted by hash, are numbered, and n-grams are counted as tuples of
these numbers. Each task adds up the n-grams of its own texts and sends them on in sorted, compressed blocks, one for each
bucket of hashes, so a frequent n-gram costs a task one entry however often it occurs, and entries spread evenly over buckets.
A bucket of the top order writes its shard, a sorted array of hashes beside an array of counts, and sends two kinds of sums down
to the next order: of each context the total and how many words follow it once, twice, more often; of each suffix how many
different words it follows, which is its continuation count (n-grams at the start of a text keep their plain counts, having
no left neighbour). So the orders are built from the top down to single words in one chain of shuffles. The discounts of an order come
from how many n-grams have counts 1 to 4.

Scoring is map-only: workers memory-map the shards and look up the distinct n-grams of some texts at a time, in order of hash. Where the
shared folder is not a local path, a worker copies a shard to an unlinked temporary file first and maps that.

The model holds every n-gram of the training texts, and there are as many buckets as input partitions, so shards and tasks stay the same
size. Bigrams are exact up to 2^32 words: their hash is a one-to-one mix of the two numbers. Words, and n-grams of three words or more,
are told apart by 64 bits; two words in one hash count as one.

Defined results: null and empty texts are one end token; words are split at the characters space and tab to carriage return, A-Z
in lower case; rows with a null doc_id are training rows; equal ids are rows of their own; without training rows every
probability is 1; discounts that too few n-grams leave undefined are 0.5, 1 and 1.5; extra columns are ignored; an empty table
gives an empty result. The shards stay in the shared folder until it is cleared.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, durable, partitions_of, read_table, scratch_path, text_slices

ORDER, CHARS, PENDING = 2, 1 << 21, 1 << 20
KEY = np.uint64
#: The multipliers of the splitmix64 finalizer, and its increment as the multiplier that appends a word.
MIX1, MIX2, STEP = KEY(0xBF58476D1CE4E5B9), KEY(0x94D049BB133111EB), KEY(0x9E3779B97F4A7C15)
ROWS = "level int, bucket int, kind string, blob binary, stats array<long>"
GRAMS, CONTEXT, SUFFIX, STATS = "grams", "context", "suffix", "stats"


# --- blocks and shards of integer columns


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers as bytes: each in its narrowest type, bytes of equal weight together, compressed."""
    n = len(columns[0])
    narrow = [c.astype(np.min_scalar_type(int(c.max())) if n else np.uint8) for c in columns]
    planes = b"".join(c.view(np.uint8).reshape(n, c.itemsize).T.tobytes() for c in narrow)
    return struct.pack(f"<QB{len(narrow)}B", n, len(narrow), *(c.itemsize for c in narrow)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<QB", data)
    sizes = struct.unpack_from(f"<{k}B", data, 9)
    planes = np.frombuffer(pa.decompress(data[9 + k :], decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    at = np.concatenate(([0], np.cumsum(sizes))) * n
    return [np.ascontiguousarray(planes[a:b].reshape(s, n).T).view(f"<u{s}").reshape(n).astype(KEY) for a, b, s in zip(at, at[1:], sizes)]


def save_shard(folder: str, level: int, bucket: int, columns: list[np.ndarray]) -> None:
    """A shard as a file that can be mapped: number of rows, item sizes, then the columns, each from a multiple of 8 bytes. A task that
    runs again writes the same file under the same name."""
    from pyarrow import fs as arrow_fs

    n = len(columns[0])
    narrow = [columns[0].astype(KEY), *(c.astype(np.min_scalar_type(int(c.max())) if n else np.uint8) for c in columns[1:])]
    fs, base = arrow_fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(tmp := f"{base}/.{uuid.uuid4().hex}", compression=None) as f:
        f.write(struct.pack("<Q8B", n, *([c.itemsize for c in narrow] + [0] * (8 - len(narrow)))))
        for c in narrow:
            f.write(c.tobytes() + bytes(-c.nbytes % 8))
    fs.move(tmp, f"{base}/{level}-{bucket:06d}.grams")


_SHARDS: OrderedDict[tuple, list[np.ndarray]] = OrderedDict()


def shard(folder: str, level: int, bucket: int, keep: int = 2048) -> list[np.ndarray]:
    """The columns of a shard, mapped into memory; none if there is no such shard. The last `keep` ones used stay mapped."""
    from pyarrow import fs as arrow_fs

    if (at := (folder, level, bucket)) in _SHARDS:
        _SHARDS.move_to_end(at)
        return _SHARDS[at]
    fs, base = arrow_fs.FileSystem.from_uri(folder)
    path, columns = f"{base}/{level}-{bucket:06d}.grams", []
    if fs.get_file_info(path).type == arrow_fs.FileType.File:
        if isinstance(fs, arrow_fs.LocalFileSystem):
            with open(path, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with tempfile.TemporaryFile() as f, fs.open_input_stream(path, compression=None) as source:
                while block := source.read(1 << 24):
                    f.write(block)
                f.flush()
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, *sizes = struct.unpack_from("<Q8B", data)
        start = 16
        for s in filter(None, sizes):
            columns.append(np.frombuffer(data, f"<u{s}", n, start))
            start += n * s + -n * s % 8
    _SHARDS[at] = columns
    while len(_SHARDS) > keep:
        _SHARDS.popitem(last=False)
    return columns


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> KEY(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def find(folder: str, level: int, bits: int, keys: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket and place of each key as rows, place -1 where it is missing; its `columns` values as rows, 0 where it is missing)."""
    own, back = np.unique(keys, return_inverse=True)
    at, out = np.full((2, len(own)), -1, np.int64), np.zeros((columns, len(own)), np.int64)
    at[0] = bucket_of(own, bits)
    used, first = np.unique(at[0], return_index=True)
    for b, lo, hi in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(own)]):
        if not (table := shard(folder, level, b)) or not len(table[0]):
            continue
        place = np.searchsorted(table[0], own[lo:hi])
        ok = table[0][np.minimum(place, len(table[0]) - 1)] == own[lo:hi]
        at[1, lo:hi][ok] = place[ok]
        for k in range(columns):
            out[k, lo:hi][ok] = table[k + 1][place[ok]]
    return at[:, back], out[:, back]


# --- words and n-grams


def mix(x: np.ndarray) -> np.ndarray:
    """One to one on 64 bits."""
    x = (x ^ (x >> KEY(30))) * MIX1
    x = (x ^ (x >> KEY(27))) * MIX2
    return x ^ (x >> KEY(31))


def gram_keys(ids: list[np.ndarray]) -> np.ndarray:
    if len(ids) == 1:
        return mix(ids[0].astype(KEY))
    key = mix((ids[0].astype(KEY) << KEY(32)) | ids[1])
    for x in ids[2:]:
        key = mix(key * STEP + x)
    return key


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each token the place of its word, tokens of each text, hashes of the different words); an end token is the empty word."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    code = lists.flatten().dictionary_encode()
    words = code.dictionary.cast(pa.binary()).to_pylist()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    code, text = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    empty = words.index(b"") if b"" in words else len(words)
    code, text = code[code != empty], text[code != empty]
    sizes = np.bincount(text, minlength=len(sizes))
    if empty == len(words):
        words.append(b"")
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), KEY, len(words))
    return np.insert(code, np.cumsum(sizes), empty), sizes + 1, hashes


def summed(keys: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Different keys in order, with their columns (equal for equal keys) and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return keys[first], [c[order[first]] for c in columns], [np.add.reduceat(v[order], first, dtype=np.int64) if len(keys) else v for v in values]


def blobs(level: int, kind: str, keys: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], bits: int) -> Iterator[dict]:
    """Rows of (level, bucket, kind, blob) for entries in order of their keys."""
    own = bucket_of(keys, bits)
    used, first = np.unique(own, return_index=True)
    for b, lo, hi in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(own)]):
        part = [c[lo:hi] for c in columns]
        order = np.lexsort(part[1::-1])
        part = [c[order] for c in part]
        yield {"level": level, "bucket": b, "kind": kind, "blob": pack(np.diff(part[0].astype(KEY), prepend=KEY(0)), *part[1:], *(v[lo:hi][order] for v in values))}


def opened(blob: bytes, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    first, *rest = unpack(blob)
    return [np.cumsum(first, dtype=KEY), *rest[: width - 1]], rest[width - 1 :]


def rows_batch(rows: list[dict]) -> pa.RecordBatch:
    kind = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_pylist([{"blob": None, "stats": None} | r for r in rows], kind)


class Tally:
    """Entries of one level (columns, counts) added up as they come, handed out as blobs once there are many."""

    def __init__(self, level: int, bits: int, columns: int):
        self.level, self.bits = level, bits
        self.held: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size, self.merged, self.width = 0, 0, columns

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> list[dict]:
        self.held.append((columns, counts.astype(np.uint32)))  # those of one run of texts
        self.size += len(counts)
        return self.merge(PENDING) if self.size - self.merged > PENDING else []

    def merge(self, most: int) -> list[dict]:
        """Equal entries become one; all leave if more than `most` are left."""
        if not self.held:
            return []
        columns = [np.concatenate([c[k] for c, _ in self.held]) for k in range(self.width)]
        keys = gram_keys(columns) if self.level else columns[0]  # level 0: words by their hash
        keys, columns, (counts,) = summed(keys, columns, [np.concatenate([n for _, n in self.held])])
        self.held, self.size, self.merged = [(columns, counts.astype(np.uint32) if len(counts) and counts.max() < 1 << 32 else counts)], len(counts), len(counts)
        if len(counts) <= most:
            return []
        self.held, self.size, self.merged = [], 0, 0
        return list(blobs(self.level, GRAMS, keys, columns, [counts], self.bits))


@dataclass
class NgramModel:
    folder: str
    order: int
    bits: int
    starts: np.ndarray  # of each bucket of words the number of its first word
    words: int
    tokens: int
    discounts: np.ndarray  # (order + 1, 4): by order and count, 3 for more
    root: tuple[float, float] = (1.0, 1.0)  # total of the counts of single words, what their discounts leave

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, one beyond that of the start if it is unknown; its count in the training texts)."""
        at, (count,) = find(self.folder, 0, self.bits, hashes, 1)
        return np.where(at[1] < 0, self.words + 1, self.starts[at[0]] + at[1]).astype(np.uint32), count

    def sequence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all tokens with a start before each text; places since the start; tokens of each text; counts of tokens)."""
        code, sizes, hashes = tokens(column)
        number, count = self.numbers(hashes)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(code) + len(sizes)) - np.repeat(begin + np.arange(len(sizes)), sizes + 1)
        return np.insert(number[code], begin, np.uint32(self.words)), place, sizes, count[code]

    def log10(self, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of every token after its text's start, in order."""
        width = lambda level: 5 if level < self.order else 1  # noqa: E731  (the top order is no context)
        a, *context = find(self.folder, 1, self.bits, gram_keys([seq]), width(1))[1]
        total, left = self.root
        less = lambda n, level: np.maximum(n - self.discounts[level][np.minimum(n, 3)], 0.0)
        p = less(a, 1) / total + left / (self.words + 1)
        for level in range(2, self.order + 1):
            keys = gram_keys([seq[k : len(seq) - level + 1 + k] for k in range(level)])
            here = np.flatnonzero(place[level - 1 :] >= level - 1)  # the n-gram from `here` on doesn't cross a text's start
            own = np.zeros((width(level), len(seq)), np.int64)
            own[:, here + level - 1] = find(self.folder, level, self.bits, keys[here], len(own))[1]
            end = here + level - 1
            end = end[context[0][end - 1] > 0]  # the context ends one token earlier
            known, *follow = (c[end - 1] for c in context)
            back = sum(d * n for d, n in zip(self.discounts[level][1:], follow)) / known
            p[end] = less(own[0, end], level) / known + back * p[end]
            context = own[1:]
        return np.log10(p[place > 0])


def learned(order: int, stats: dict[int, np.ndarray]) -> tuple[np.ndarray, tuple[float, float]]:
    """(discounts by order and count, (total, what is left) of single words) from how many entries have counts 1 to 4."""
    d = np.tile([0.0, 0.5, 1.0, 1.5], (order + 1, 1))
    for level, s in stats.items():
        n = s[:4].astype(float)
        if (n[:3] > 0).all():
            y = n[0] / (n[0] + 2 * n[1])
            own = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
            if all(0 < x <= k for k, x in enumerate(own, 1)):
                d[level, 1:] = own
    n1, n2, _, _, rest, total = stats[1].tolist()
    return d, (float(total), (d[1, 1] * n1 + d[1, 2] * n2 + d[1, 3] * rest) / total)


def count_words(train: DataFrame, folder: str, bits: int) -> DataFrame:
    """Write the shards of words (hash, count); (bucket, n, total) of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(0, bits, 1)
        for batch in batches:
            for part in text_slices(batch, CHARS):
                code, _, hashes = tokens(part["text"])
                n = np.bincount(code, minlength=len(hashes))
                if rows := tally.add([hashes[n > 0]], n[n > 0]):
                    yield rows_batch(rows)
        if rows := tally.merge(-1):
            yield rows_batch(rows)

    def write(table: pa.Table) -> pa.Table:
        bucket, found = table["bucket"][0].as_py(), [opened(b.as_py(), 1) for b in table["blob"]]
        keys, _, (n,) = summed(np.concatenate([c[0] for c, _ in found]), [], [np.concatenate([v[0] for _, v in found])])
        save_shard(folder, 0, bucket, [keys, n])
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": [len(keys)], "total": [int(n.sum())]})

    return train.select("text").mapInArrow(count, ROWS).groupBy("bucket").applyInArrow(write, "bucket int, n long, total long")


def count_grams(train: DataFrame, model: NgramModel) -> DataFrame:
    """Rows of blobs: the n-grams of the top order, and the shorter ones at the start of a text, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {level: Tally(level, model.bits, level) for level in range(1, model.order + 1)}
        for batch in batches:
            for part in text_slices(batch, CHARS):
                seq, place, _, _ = model.sequence(part["text"])
                for level, tally in tallies.items():
                    if level == model.order:
                        end = np.flatnonzero(place >= max(1, level - 1))
                    elif level > 1:
                        end = np.flatnonzero(place == level - 1)
                    else:
                        continue
                    ids = [seq[end - level + 1 + k] for k in range(level)]
                    _, ids, (n,) = summed(gram_keys(ids), ids, [np.ones(len(end), np.int64)])
                    if rows := tally.add(ids, n):
                        yield rows_batch(rows)
        for tally in tallies.values():
            if rows := tally.merge(-1):
                yield rows_batch(rows)

    return train.select("text").mapInArrow(run, ROWS)


def settle(rows: DataFrame, model: NgramModel, level: int) -> DataFrame:
    """Write the shards of one order from its rows; what is left are the rows of lower orders, those this order sends down, and its
    numbers of entries: with counts 1, 2, 3, 4, with 3 or more, and the sum of all counts."""
    folder, bits, order = model.folder, model.bits, model.order

    def run(table: pa.Table) -> pa.Table:
        own, out = [], []
        for r in table.to_pylist():
            (own if r["level"] == level and r["kind"] != STATS else out).append(r)
        if not own:
            return pa.Table.from_batches([rows_batch(out)])
        columns, values = [], []
        for r in own:
            ids, got = opened(r["blob"], level)
            zero = np.zeros(len(ids[0]), np.int64)
            got = [v.astype(np.int64) for v in got]
            columns.append(ids)
            values.append([zero, *got] if r["kind"] == CONTEXT else [got[0], *[zero] * 4])
        ids = [np.concatenate([c[k] for c in columns]) for k in range(level)]
        keys, ids, sums = summed(gram_keys(ids), ids, [np.concatenate([v[k] for v in values]) for k in range(5)])
        save_shard(folder, level, own[0]["bucket"], [keys, *(sums if level < order else sums[:1])])
        a = sums[0]
        out.append({"level": level, "bucket": own[0]["bucket"], "kind": STATS, "stats": [*((a == k).sum() for k in (1, 2, 3, 4)), (a >= 3).sum(), a.sum()]})
        if level > 1:
            some = a > 0
            a, ids = a[some], [c[some] for c in ids]
            for kind, part, got in ((CONTEXT, ids[:-1], [a, *(x.astype(np.int64) for x in (a == 1, a == 2, a >= 3))]), (SUFFIX, ids[1:], [np.ones(len(a), np.int64)])):
                out += blobs(level - 1, kind, *summed(gram_keys(part), part, got), bits)
        return pa.Table.from_batches([rows_batch(out)])

    return rows.groupBy("bucket").applyInArrow(run, ROWS)


def fit_model(train: DataFrame, order: int = ORDER) -> NgramModel | None:
    """Count the texts of train and write the model's shards; None without rows."""
    if order < 1:
        raise ValueError("the order is 1 or more")
    spark = train.sparkSession
    n = max(partitions_of(train), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits, folder = max(0, n - 1).bit_length(), scratch_path(spark, "ngrams")
    starts, words, total = np.zeros(1 << bits, np.int64), 0, 0
    for r in durable(count_words(train, folder, bits), "ngram-words").orderBy("bucket").collect():  # a row for each shard
        starts[r.bucket], words, total = words, words + r.n, total + r.total
    if not words:
        return None
    if words + 2 > 1 << 32:
        raise ValueError("more than 2^32 different words")
    model = NgramModel(folder, order, bits, starts, words, total, np.zeros((order + 1, 4)))
    rows = count_grams(train, model)
    for level in range(order, 0, -1):
        rows = settle(rows, model, level)
    found = rows.groupBy("level").agg(*[F.sum(F.get("stats", F.lit(k))).alias(f"n{k}") for k in range(6)]).collect()
    model.discounts, model.root = learned(order, {r.level: np.array(r[1:], np.int64) for r in found})
    return model


def score_texts(docs: DataFrame, model: NgramModel | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id), n_tokens, n_known, base_score, score, perplexity of each row."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, CHARS):
                if model is None:
                    sizes = tokens(part["text"])[1]
                    known, base, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
                else:
                    seq, place, sizes, count = model.sequence(part["text"])
                    text = np.repeat(np.arange(len(sizes)), sizes)
                    known = np.bincount(text, count > 0, len(sizes)).astype(np.int64)
                    base = np.bincount(text, np.log10((count + 1) / (model.tokens + model.words + 1)), len(sizes))
                    score = np.bincount(text, model.log10(seq, place), len(sizes))
                yield beside(part, keep, n_tokens=sizes, n_known=known, base_score=base, score=score, perplexity=10 ** (-score / sizes))

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 2 by 7: never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def language_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, by a model of the rows that aren't held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_model(docs.where(~held_out(F.col("doc_id"))), order)
    out = score_texts(docs, model)
    total = F.lit(0 if model is None else model.tokens).cast("long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", total.alias("train_tokens"), "base_score", "score")


def op11_language_model(spark, sf_dir):
    return language_scores(read_table(spark, sf_dir, "documents"))
