"""Null, repeated and very large ids in every operator: ids come back as they are, a row for each row."""

import hashlib
import zlib

import numpy as np
import pytest

from subseqrules.llm import bpe, embeddings, media, mixing, quality, simhash, suffix_dedup, token_files, toxicity

from .test_ops import R, brute_spans, groups, slow_fingerprint, text

SHARED = text(30)
BIG = 2**62
ROWS = [
    (None, SHARED), (None, text(25)), (None, None), (BIG + 1, SHARED + " x"), (BIG + 2, "y " + SHARED), (7, text(9) + " " + SHARED), (7, "z" + SHARED), (7, "z" + SHARED),
    (-BIG, text(12)), (8, ""), (9, "=" * 300), (10, "=" * 200 + text(5)), (11, "ab" * 90 + text(20)), (12, "ab" * 60), (BIG + 3, text(200)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, place long, bucket long, tag string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), 0.5, 1, 2, "clash") for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(2).cache()


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_simhash(docs):
    rows = [(i, slow_fingerprint(t)) for i, t in ROWS]
    top = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4])
    least = [min((rows[k][0] for k in range(len(rows)) if top[k] == top[j] and rows[k][0] is not None), default=None) for j in range(len(rows))]
    same([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs).collect()], [(i, f, c) for (i, f), c in zip(rows, least)])


def test_media(docs, spark, tmp_path):
    media.store_texts(docs, f"file://{tmp_path}/m")
    got = media.media_features(spark.read.parquet(f"file://{tmp_path}/m")).collect()
    pad = lambda t: (b := (t or "").encode()) + b"\xff" * (-len(b) % 576 if b else 576)
    same([(r.doc_id, r.payload_sha256) for r in got], [(i, hashlib.sha256(pad(t)).hexdigest()) for i, t in ROWS])


def test_suffix(docs):
    known = [(i, t) for i, t in ROWS if i is not None]
    want = [*brute_spans(known), *[(None, len((t or "").encode()), (t or "").encode()) for i, t in ROWS if i is None]]
    same([(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()], want)


def test_a_run_of_one_byte_is_few_entries():
    assert len(suffix_dedup.pieces(b"a" * 1_000_000)[0]) < 100
    assert len(suffix_dedup.pieces(b"- = " * 100_000)[0]) < 100
    anchor, content, first, windows = suffix_dedup.pieces(("ab" * 500 + text(3000)).encode())
    assert (np.cumsum(windows)[:-1] == first[1:]).all()


def test_token_files(docs, spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib, folder = Tokenizer.from_file(P.path("word_bpe_49k.json")), f"file://{tmp_path}/t"
    token_files.write_token_files(docs, folder, P.path("word_bpe_49k.json"), file_ids=100)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    ids = lambda t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in ROWS])
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_word_encoder_against_the_library():
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_files.WordEncoder(P.path("word_bpe_49k.json"))
    letters = [*"aabbtheéßÉÀΣσςİıÅ  \n\t.,!'\"019世😀\x1c\x85​\xa0̈́ﬁǅ\x0b\r-_", "<|endoftext|>", "'s", "'ll", " the "]
    for _ in range(40):
        texts = [None if R.random() < 0.05 else "".join(R.choice(letters, R.integers(0, 40))) for _ in range(30)]
        sizes, ids = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe(docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len(ids := lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in ROWS]
    same([(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()], want)
    same([(r.doc_id, r.n_tokens) for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()], [w[:2] for w in want])


def test_scores(docs):
    from pyspark.sql import functions as F

    same([(r.doc_id,) for r in toxicity.score(docs, toxicity.ToxicModel()).collect()], [(i,) for i, _ in ROWS])
    same([(r.doc_id, r.text) for r in toxicity.reject(docs, toxicity.ToxicModel()).collect()], ROWS)
    same([(r.doc_id,) for r in quality.quality_scores(docs, np.zeros(quality.COLUMNS), F.col("source"), F.col("lang")).collect()], [(i,) for i, _ in ROWS])
    mix = mixing.mix_sources(docs, block=8, bucket_rows=4)
    same([tuple(r) for r in mix.select("doc_id", "source", "size", "seq", "bucket").distinct().select("doc_id", "source", "size").collect()], [(i, f"s{k % 3}", len((t or "").split())) for k, (i, t) in enumerate(ROWS)])


def test_embeddings(spark):
    rows = [(5, [1, 0.1, 0, 0]), (5, [1, 0.2, 0, 0]), (None, [1, 0.15, 0, 0]), (None, [0, 0, 1.0, 0]), (None, [0, 0, 1.0, 0]), (BIG + 1, [0, 0, 0, 1.0]), (BIG + 2, [0, 0, 0.01, 1.0]), (None, None), (3, [0.0, 1, 0, 0])]
    df = spark.createDataFrame([(i, v and [float(x) for x in v], "clash") for i, v in rows], "vec_id long, embedding array<double>, v string")
    want = [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (None, 1, None, True), (BIG + 1, 1, BIG + 1, True), (BIG + 2, 1, BIG + 1, False), (None, 0, None, True), (3, 0, 3, True)]
    for how in ({}, {"pivots": 2, "block": 2}):
        same([tuple(r) for r in embeddings.embedding_links(df, **how).select("vec_id", "n_links", "component_id", "kept").collect()], want)
