"""Fill-in-middle: a text is cut at two places and its middle is moved to the end, behind sentinels.

Cuts are drawn in units, code points or bytes, while texts are UTF-8 in Arrow's buffers. Most characters are one byte, so a
batch gets a sparse index of exceptions only: for each multibyte character its first byte's position and the bytes it has
beyond one. A code point is turned into a byte by adding the excess of the exceptions before it, found with searchsorted, and a
byte into a code point by taking it away again; between exceptions both are plain arithmetic, and no text is decoded.

Draws are the 8-digit groups of the hex sha256 of `1:` and the decimal doc_id, so they depend on nothing but the id.

Defined results: null texts count as empty; an empty text, one that holds a sentinel, and the share of rows left plain come
out as they are, without lengths; a null doc_id is drawn from `1:` alone; equal ids are rows of their own with equal draws;
extra columns are ignored; an empty table gives an empty result. Texts may be of any length: the index of a text is
as large as its multibyte characters are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, read_table, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


class CharIndex:
    """The multibyte characters of one or many texts laid end to end: where they start and what they have beyond one byte."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)))
        self.char = self.at - self.excess[:-1]  # the code point each of them is

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points that start before the given bytes."""
        k = np.searchsorted(self.at, byte)
        inside = np.where(k > 0, np.maximum(0, self.at[np.maximum(k, 1) - 1] + 1 + self.excess[k] - self.excess[np.maximum(k, 1) - 1] - byte), 0) if len(self.at) else 0
        return byte - self.excess[k] + inside

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """The bytes at which the given code points start."""
        return char + self.excess[np.searchsorted(self.char, char)]


def draws(ids: list[int | None]) -> np.ndarray:
    """Four numbers below 2^32 for each id."""
    hexes = (hashlib.sha256(b"1:" + (b"" if i is None else str(i).encode())).digest()[:16] for i in ids)
    return np.frombuffer(b"".join(hexes), ">u4").reshape(-1, 4).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes end to end, where each text starts and, last, where the last one ends); null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not ends[-1] - ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def cut(data: np.ndarray, starts: np.ndarray, h: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(code points of each text, its two cuts in code points, the same in bytes of the text)."""
    index = CharIndex(data)
    edge = index.chars(starts)
    n = np.diff(edge)
    size = n if unit == "chars" else np.diff(starts)
    a, b = h[:, 0] % (size + 1), h[:, 1] % (size + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    if unit == "bytes":  # a cut inside a character moves to its end
        lo, hi = (index.chars(starts[:-1] + x) - edge[:-1] for x in (lo, hi))
    return n, lo, hi, index.bytes(edge[:-1] + lo) - starts[:-1], index.bytes(edge[:-1] + hi) - starts[:-1]


def arrange(text: bytes, form: str, lo: int, hi: int) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, text[:lo], SUFFIX, text[hi:], MIDDLE, text[lo:hi]))
    return b"".join((SUFFIX, text[hi:], PREFIX, text[:lo], MIDDLE, text[lo:hi])) if form == "spm" else text


def restore(output: bytes, form: str) -> bytes:
    """The text again, from what was written and its form; a text that is not plain holds no sentinel, so the first ones are ours."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def fill_middle(docs: DataFrame, *, unit: str = "chars", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output. `unit`: what cuts are drawn in; rows whose third
    draw is `plain_from` or more of 100 stay plain, of the others those with a fourth below `spm_below` put the suffix first."""
    if unit not in ("chars", "bytes"):
        raise ValueError(f"unknown unit {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, starts = text_bytes(part["text"])
                h = draws(part["doc_id"].to_pylist())
                n, lo, hi, blo, bhi = cut(data, starts, h, unit)
                texts = [data[a:b].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist())]
                plain = (n == 0) | (h[:, 2] % 100 >= plain_from) | np.array([any(s in t for s in (PREFIX, SUFFIX, MIDDLE)) for t in texts], bool)
                form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_below, "spm", "psm")).tolist()
                out = pa.array([arrange(*x) for x in zip(texts, form, blo.tolist(), bhi.tolist())], pa.binary()).view(pa.string())
                known = [pa.array(x, mask=plain) for x in (lo, hi - lo, blo, bhi - blo)]
                yield beside(part, ["doc_id"], n=n, form=form, **dict(zip(("prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"), known)), output=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def restored(rows: DataFrame) -> DataFrame:
    """rows with `output` and `form`: the same and `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column="output"):
                data, starts = text_bytes(part["output"])
                texts = [restore(data[a:b].tobytes(), f) for a, b, f in zip(starts.tolist(), starts[1:].tolist(), part["form"].to_pylist())]
                yield beside(part, part.schema.names, text=pa.array(texts, pa.binary()).view(pa.string()))

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, text string")


def op12_fill_middle(spark, sf_dir):
    rows = restored(fill_middle(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(s, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS d FROM d),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS x FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM o
"""
