"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token one token is stored: the last token of the prefix's encoding. An automaton (Aho-Corasick
over the vocabulary) reports which tokens are suffixes of each prefix; going from the longest to the shortest, the first
token t whose predecessor (the token stored where t starts) forms a compatible pair with it is the one, and it is unique.
Following the back-pointers from the end gives the ids. A pair is compatible if encoding its two strings joined would
give just these two tokens, which is found by undoing merges from the later ranks to the earlier.

The vocabulary is a file of the `tokenizers` library: byte-level BPE with the usual word pattern. Its path is a
parameter. Texts are cut into pre-tokens first; pre-tokens repeat, so each worker remembers the ids of those it has seen
(forgetting all when the memory holds about MEMO bytes, a parameter; results don't depend on it).

Defined results: null is encoded as the empty text, the empty text has no ids; extra columns are not carried; rows with
equal or null ids give a row each, ids as they are; an empty table gives an empty result; strings of special tokens in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, read_table, takes_over, text_slices, values

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
MEMO, PAIRS = 1 << 27, 1 << 19
NAMED = regex.compile(r"[\p{L}\p{N}]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


class PrefixBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, pattern: str, memory: int = MEMO):
        import ahocorasick
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = byte_letters()
        self.table = str.maketrans({b: c for b, c in self.letters.items()})
        back = {c: b for b, c in self.letters.items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        #: (left, right) -> (rank, joined); and for a token made by merges, its first way to be made
        self.merged = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (r, c) in self.merged.items():
            self.made.setdefault(c, (r, a, b))
        self.suffixes = ahocorasick.Automaton()
        reach = {c for c in range(len(vocab)) if c in self.made} | {vocab[c] for c in back if c in vocab}
        for s, i in vocab.items():
            if i in reach:
                self.suffixes.add_word(s, (len(s), i))
        self.suffixes.make_automaton()
        # the library's \\s is Unicode's White_Space, without the separators 1C to 1F that Python counts
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # the pattern module may know letters and digits of a later Unicode than the library does
        whole = ByteLevel(add_prefix_space=False).pre_tokenize_str
        new = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and NAMED.match(c) and min(len(whole("a" + c)), len(whole("1" + c))) > 1]
        self.newer, self.older = frozenset(new), {ord(c): "\U000f0000" for c in new}
        self.odd, self.gap = re.compile(r"\s\s|\A\s|\s\Z"), re.compile(r"(?<=\S) (?=\S)")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fit: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}  # of a space and letters, by the letters
        self.other: dict[str, tuple[int, ...]] = {}
        self.held, self.memory = 0, memory

    def compatible(self, left: int, right: int) -> bool:
        """Do left and right stay two tokens when their joined string is encoded?

        Undo the latest merge of either side again and again; if the two tokens that touch at the border could have
        merged before the merge that was undone last, the border would not have stayed."""
        limit, a, b = 1 << 60, left, right
        while True:
            rank = self.merged.get((a, b), (1 << 60,))[0]
            if rank < limit:
                return False
            ra, rb = self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal ranks the left one merges first, so the right one is undone first
                limit, a = ra, self.made[a][2]
                if self.merged.get((a, b), (1 << 60,))[0] < limit:
                    return False
            else:
                limit, b = rb, self.made[b][1]
                if self.merged.get((a, b), (1 << 60,))[0] <= limit:
                    return False

    def word(self, letters: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as letters."""
        n = len(letters)
        last, at = [-1] * (n + 1), [0] * (n + 1)
        fit = self.fit
        for end, (size, token) in self.suffixes.iter(letters):  # the longest suffix of each prefix comes first
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                ok = fit.get((before, token))
                if ok is None:
                    if len(fit) > PAIRS:
                        fit.clear()
                    ok = fit[before, token] = self.compatible(before, token)
            else:
                ok = self.whole(token)
            if ok:
                last[end + 1], at[end + 1] = token, start
        out = []
        while n:
            out.append(last[n])
            n = at[n]
        return tuple(out[::-1])

    def whole(self, token: int) -> bool:
        """Is the token the encoding of its own string? It is if its two parts are, and nothing but its merge takes their border."""
        key = (-1, token)
        if key not in self.fit:
            if token not in self.made:
                return True
            rank, a, b = self.made[token]
            later = max(self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0])
            own = self.merged.pop((a, b))
            self.fit[key] = self.whole(a) and self.whole(b) and rank >= later and self.compatible(a, b)
            self.merged[a, b] = own
        return self.fit[key]

    def remember(self, memo: dict, key: str, word: str) -> tuple[int, ...]:
        ids = self.word(word.encode().decode("latin-1").translate(self.table))
        if self.held > self.memory:
            self.memo.clear()
            self.other.clear()
            self.held = 0
        self.held += len(word) + 200
        memo[key] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        """A space between two characters that aren't white space always begins a pre-token, so texts are cut there
        first; what lies between two cuts is one pre-token if it holds letters only, and goes through the pattern if not."""
        get, out = self.memo.get, []
        parts = self.gap.split(text) if self.odd.search(text) else text.split(" ")
        lead = ""
        for part in parts:
            ids = get(part) if lead else None
            if ids is None:
                if lead and part.isalpha():
                    ids = self.remember(self.memo, part, lead + part)
                else:
                    for w in self.cut_words(lead + part):
                        out += self.other.get(w) or self.remember(self.other, w, w)
                    lead = " "
                    continue
            out += ids
            lead = " "
        return out

    def cut_words(self, part: str) -> list[str]:
        if part.isascii() or self.newer.isdisjoint(part):
            return self.pattern.findall(part)
        same = part.translate(self.older)
        return [part[m.start() : m.end()] for m in self.pattern.finditer(same)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str, int], PrefixBPE] = {}


def loaded(path: str, pattern: str, memory: int = MEMO) -> PrefixBPE:
    """One encoder for each worker process, until a task of another operator comes to it."""
    takes_over("bpe", _LOADED.clear)
    if (path, pattern, memory) not in _LOADED:
        _LOADED[path, pattern, memory] = PrefixBPE(path, pattern, memory)
    return _LOADED[path, pattern, memory]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded: each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in chain.from_iterable(map(text_slices, batches)):
            ids = [np.array(bpe.encode(t), dtype="<u4") for t in values(batch["text"])]
            yield beside(batch, ["doc_id"], n_tokens=[len(x) for x in ids], ids=[x.tobytes() for x in ids], decoded=[bpe.decode(x.tolist()) for x in ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, path: str, pattern: str, memory: int = 2 * MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, made where the ids are, so that only digests leave the worker."""

    def run(batches):
        bpe = loaded(path, pattern, memory)
        for batch in chain.from_iterable(map(text_slices, batches)):
            rows = []
            for t in values(batch["text"]):
                ids = bpe.encode(t)
                rows.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            yield beside(batch, ["doc_id"], **dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows))))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir):
    import public_tokenizers as public

    return digests(read_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)
