"""Fill-in-middle against a decoded, character by character version, and the index of characters against Python's."""

import hashlib

import numpy as np
import pytest

from subseqrules.llm import fill_middle as fm

TEXTS = [None, "", "a", "é", "x" * 50, "añ" * 40 + "漢字" * 9 + "😀" * 7, "has <P> inside", "ends <S", "><M", "<" * 30, "😀" * 1000, "taiĺ z", "a" * 300_000 + "é" + "b" * 300_000]
SCHEMA = "doc_id long, text string, n long, form string, output string, h long"


def slow(i, t):
    s = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in range(0, 32, 8)]
    t = t or ""
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, t)
    p, m, x = t[:a], t[a:b], t[b:]
    return (i, n, "spm", a, b - a, f"<S>{x}<P>{p}<M>{m}") if h[3] % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{x}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    own = [(k * 7 + j * 1000, t) for j in range(12) for k, t in enumerate(TEXTS[:-1])] + [(5, TEXTS[-1]), (-3, "negative é id"), (2**62 + 1, "large " * 9), (None, "no id ü"), (7, "a"), (7, "a")]
    return own


def test_forms_and_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, 3, "clash", "clash", 4) for i, t in rows], SCHEMA).repartition(3)
    got = fm.restored(fm.fill_middle(docs)).collect()
    key = lambda r: str(r[:3]) + str(r[5])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((slow(i, t) for i, t in rows), key=key)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_middle(docs.limit(0)).count() == 0


def test_byte_cuts(spark, rows):
    docs = spark.createDataFrame([(i, t, 3, "clash", "clash", 4) for i, t in rows], SCHEMA)
    for r in fm.restored(fm.fill_middle(docs, unit="bytes")).collect():
        if r.form != "plain":  # cuts lie between characters, and both ways of counting agree
            raw = r.text.encode()
            assert len(raw[: r.prefix_bytes].decode()) == r.prefix_chars
            assert len(raw[r.prefix_bytes :][: r.middle_bytes].decode()) == r.middle_chars
    with pytest.raises(ValueError):
        fm.fill_middle(docs, unit="words")


def test_index():
    text = "".join(np.random.default_rng(3).choice(list("abcé漢😀"), 500))
    raw, index = text.encode(), fm.CharIndex(np.frombuffer(text.encode(), np.uint8))
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.bytes(np.arange(len(text) + 1)).tolist() == at
    started = [sum(a < b for a in at[:-1]) for b in range(len(raw) + 1)]
    assert index.chars(np.arange(len(raw) + 1)).tolist() == started


def test_restore_is_unambiguous():
    for t in ("<", "<S", "S>", "<M", "P><", "<<<>>>"):
        for a in range(len(t) + 1):
            for b in range(a, len(t) + 1):
                for form in ("psm", "spm"):
                    assert fm.restore(fm.arrange(t.encode(), form, a, b), form) == t.encode()


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = fm.op12_fill_middle(spark, sf)
    want = con.execute(fm.OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
