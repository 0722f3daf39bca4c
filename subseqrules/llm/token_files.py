"""Token-ID files of directly addressable codes.

A file holds the ids of a run of documents in ascending doc_id order. Ids are split into chunks of 8 bits: level 0 has
the lowest chunk of every id, level k + 1 the next chunk of those ids of level k whose continuation bit is set. A rank
directory counts the set bits before every block of 512, so any token is reached without decoding another: its place in
the next level is the rank of its bit. Layout (little-endian): magic, documents, ids, levels; doc_ids; a bit for each
document, 0 where its id is null; first id of each document; then for each level its length, chunks, packed continuation
bits, rank directory.

Texts are dealt by ranges of (doc_id, hash of the text), so files follow each other by (partition, number). A file is written under another
name and moved, so a task that runs again leaves one whole file. Reading goes through Spark's binaryFile source.

Defined results: null is the empty text, which is its end id alone; null ids come first and stay null; rows with equal ids
(null ones too) are rows of their own and follow each other by hash of the text; extra columns are ignored; a document longer than a file's size has a file of its own; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from string import punctuation as MARKS

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, partitions_of, read_table, scratch_path, text_slices

MAGIC, BLOCK, FILE_IDS, MEMO, CHARS = b"DACIDS02", 512, 1 << 21, 1 << 20, 1 << 23


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, packed continuation bits, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append(((rest & 255).astype(np.uint8), bits, (np.cumsum(blocks) - blocks).astype("<u4")))
        rest = rest[more] >> 8
        if not more.any():
            break
    return levels


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    first = np.cumsum(counts) - counts
    known = np.array([i is not None for i in doc_ids], bool)
    numbers = np.array([0 if i is None else int(i) for i in doc_ids], "<i8")
    parts = [MAGIC, struct.pack("<QQQ", len(numbers), len(ids), len(levels)), numbers.tobytes(), np.packbits(known, bitorder="little").tobytes(), first.astype("<u8").tobytes()]
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class TokenFile:
    """Random access to the tokens of a file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n, levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.known = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs, bitorder="little").astype(bool)
        at += -(-docs // 8)
        self.first = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        at, self.levels = at + 8 * docs, []
        for _ in range(levels):
            n = struct.unpack_from("<Q", data, at)[0]
            b, r = -(-n // 8), -(-n // BLOCK)
            self.levels.append((np.frombuffer(data, np.uint8, n, at + 8), np.frombuffer(data, np.uint8, b, at + 8 + n), np.frombuffer(data, "<u4", r, at + 8 + n + b)))
            at += 8 + n + b + 4 * r

    def token(self, i: int) -> int:
        """The i-th id, decoding nothing but its own chunks."""
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(before.sum())
        return out

    def ids(self) -> np.ndarray:
        at, out = np.arange(self.n), np.zeros(self.n, np.uint32)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


class Ragged:
    """Words and the ids of each, as Arrow strings and one flat array; looked up in bulk."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.flat, self.first = pa.array([""], pa.large_string()), np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 if it isn't there."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words.cast(pa.large_string())])
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each place, all their ids one after another)."""
        start, sizes = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        at = np.repeat((start - (ends - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return sizes, self.flat[at]


class WordEncoder:
    """Ids by the `tokenizers` library, which each distinct word goes through once while it is remembered.

    The vocabulary's tokens never hold white space, so a text's ids are those of its parts between white space,
    case aside, and of letters with marks behind them, those of the letters and those of the marks. Texts are split and
    words told apart in Arrow; only words that are new are Python strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.whole, self.parts = Ragged(), Ragged()  # words as they stand in the text; letters in lower case, and what isn't
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.lib.no_truncation()
        self.lib.no_padding()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after another); null is the empty text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        if len(self.whole.words) > MEMO:
            self.whole.clear()
        if len(self.parts.words) > MEMO:
            self.parts.clear()
        at = self.whole.find(words.dictionary)
        if len(new := np.flatnonzero(at < 0)):
            at[new] = len(self.whole.words) + np.arange(len(new))
            self.learn(words.dictionary.take(pa.array(new)))
        sizes, ids = self.whole.gather(at[words.indices.to_numpy(zero_copy_only=False)])
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.diff(upto), ids

    def learn(self, words: pa.Array) -> None:
        """Add words that aren't known."""
        cores = pc.utf8_rtrim(words, MARKS)
        joined = "\n".join(cores.to_numpy(zero_copy_only=False))
        low = joined.lower().split("\n")
        plain = np.fromiter(map(str.isalpha, low), bool, len(low))
        if "\u03a3" in joined:  # a capital sigma becomes another letter at a word's end here, but not in the library
            plain &= np.array(["\u03a3" not in c for c in joined.split("\n")])
        rest = np.flatnonzero(~plain | (pc.binary_length(words).to_numpy() > pc.binary_length(cores).to_numpy()))
        tail = np.full(len(low), "", object)
        some = words.take(pa.array(rest)).to_numpy(zero_copy_only=False)
        sizes = pc.utf8_length(cores).to_numpy()[rest] * plain[rest]
        tail[rest] = [w[n:] for w, n in zip(some.tolist(), sizes.tolist())]
        head = pc.if_else(pa.array(plain), pa.array(low, pa.large_string()), "").dictionary_encode()
        tail = pa.array(tail, pa.large_string()).dictionary_encode()
        at = self.parts.find(pa.concat_arrays([head.dictionary, tail.dictionary]))
        n = len(head.dictionary)
        for kind, lo, hi, learn in ((head.dictionary, 0, n, self.letters), (tail.dictionary, n, len(at), self.others)):
            new = np.flatnonzero(at[lo:hi] < 0)
            at[lo + new] = len(self.parts.words) + np.arange(len(new))
            missing = kind.take(pa.array(new))
            found = [learn(missing.slice(k, 4096).to_numpy(zero_copy_only=False).tolist()) for k in range(0, len(missing), 4096)]
            if found:
                self.parts.add(missing, *map(np.concatenate, zip(*found)))
        both = np.stack((at[:n][head.indices.to_numpy()], at[n:][tail.indices.to_numpy()]), axis=1).reshape(-1)
        sizes, ids = self.parts.gather(both)
        self.whole.add(words, sizes.reshape(-1, 2).sum(axis=1), ids)

    def others(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.lib.encode_batch_fast(own, add_special_tokens=False)]
        return np.array(list(map(len, ids)), np.int64), np.fromiter(chain.from_iterable(ids), np.uint32)

    def letters(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters go through together: each ends with the first token that ends a word."""
        ids = np.array(self.lib.encode(" ".join(own), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(own):  # a letter that the library takes for none
            return self.others(own)
        return np.diff(ends, prepend=0), ids


_ENCODERS: dict[str, WordEncoder] = {}


def write_token_files(docs: DataFrame, folder: str, path: str, *, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode the texts and write the files; returns the manifest (file, part, number, n_docs, n_ids)."""

    def run(batches):
        from pyarrow import fs as arrow_fs

        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        enc = _ENCODERS[path]
        fs, base = arrow_fs.FileSystem.from_uri(folder)
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []

        def save():
            nonlocal number
            name = f"{base}/part-{part:06d}-{number:06d}.dac"
            data = pack_file([i for i, _ in held], np.array([len(x) for _, x in held], np.int64), np.concatenate([x for _, x in held]))
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(tmp := f"{base}/.{uuid.uuid4().hex}") as f:
                f.write(data)
            fs.move(tmp, name)
            row = (name.rsplit("/", 1)[1], part, number, len(held), sum(len(x) for _, x in held))
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("file", "part", "number", "n_docs", "n_ids"), row))])

        size = 0
        for batch in chain.from_iterable(text_slices(b, CHARS) for b in batches):
            counts, ids = enc.encode(batch["text"])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
            for i, a, b in zip(batch["doc_id"].to_pylist(), (ends - counts - 1).tolist(), ends.tolist()):
                if held and size + b - a > file_ids:
                    yield save()
                    size = 0
                held.append((i, ids[a:b]))
                size += b - a
        if held:
            yield save()

    n = max(partitions_of(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = own.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return durable(dealt.mapInArrow(run, "file string, part long, number long, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the folder's files."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                f = TokenFile(data.as_py())
                ids = f.ids()
                ends = np.append(f.first[1:], f.n)
                part, number = name.rsplit("/", 1)[1].removesuffix(".dac").split("-")[1:]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(f.first.tolist(), ends.tolist())]
                n = len(crc)
                columns = {"part": np.full(n, int(part)), "number": np.full(n, int(number)), "doc_id": pa.array(f.doc_ids, mask=~f.known), "at": f.first, "n_tokens": ends - f.first, "ids_crc32": np.array(crc, np.int64)}
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    rows = durable(files.mapInArrow(run, "part long, number long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("part_start", before(Window.orderBy("part"))).drop("n")
    sizes = sizes.withColumn("file_start", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part")
    out = rows.join(sizes, ["part", "number"])
    return out.select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir):
    import public_tokenizers as public

    folder = scratch_path(spark, "token-files")
    if not write_token_files(read_table(spark, sf_dir, "documents"), folder, public.path("word_bpe_49k.json")).isEmpty():
        return read_token_files(spark, folder)
    return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
