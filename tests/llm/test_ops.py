"""The operators of subseqrules.llm against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subseqrules.llm import bpe, components, embeddings, induced, media, mixing, quality, simhash, suffix_dedup, token_counts, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words long, start long, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = np.random.default_rng(11)


def text(n):
    return " ".join("".join(R.choice(list("abcdeé"), R.integers(1, 5))) for _ in range(n))


BASE = [text(40) for _ in range(6)]
ROWS = [
    (1, BASE[0], "en", "s1"), (2, BASE[0], "en", "s1"), (3, BASE[0] + " tail", "en", None), (4, None, None, "s2"), (5, "", "de", "s2"), (6, "one two", "de", "s1"),
    (7, BASE[1] + "\n" + BASE[2], "fr", "s3"), (8, BASE[2] + " x " + BASE[1], "fr", "s1"), (9, "a" * 300, "en", "s1"), (10, "a" * 200, "en", "s1"), (10, BASE[3], "en", "s1"),
    (10, BASE[3], "en", "s1"), (11, "\t \n", "en", ""), (12, text(3000), "en", "s1"), (13, BASE[4][:120] + "<|endoftext|>" + BASE[4][100:], "xx", "s1"), (-4, BASE[4], None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(*r, len(r[1] or ""), 7, 8, "clash") for r in ROWS]
    return spark.createDataFrame(data, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    cap, out, rest = {s: 2.0 * sizes[s] for s in names}, {}, 1.5 * sum(sizes.values())
    left = list(names)
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > cap[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap[s]
            rest -= cap[s]
            left.remove(s)


def test_mixing(docs, none):
    mix = mixing.mix_sources(docs, block=16, bucket_rows=4).collect()
    size = {}
    for i, t, _, s in ROWS:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(size)
    taken, slots = {}, [r.slot for r in mix if r.slot is not None]
    for r in mix:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        taken[r.source] = taken.get(r.source, 0) + (r.words if r.slot is not None else 0)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert len({(r.doc_id, r.bucket, r.seq) for r in mix}) == len(ROWS)
    assert sorted(set(slots)) == list(range(len(set(slots))))
    per = {}
    for r in mix:
        if r.slot is not None:
            per[r.doc_id, r.bucket, r.seq] = per.get((r.doc_id, r.bucket, r.seq), 0) + r.words
            assert per[r.doc_id, r.bucket, r.seq] <= 2 * r.size
    assert mixing.mix_sources(none).count() == 0
    assert sorted(map(str, mix)) == sorted(map(str, mixing.mix_sources(docs.repartition(5), block=16, bucket_rows=4).collect()))


def test_golden_lattice_spreads_every_share():
    n = 1000
    g = mixing.golden_step(n)
    at = [i * g % n for i in range(n)]
    assert sorted(at) == list(range(n))
    for lo, hi in ((0, 100), (100, 450), (450, 1000)):
        for m in (50, 200, 700):
            assert abs(sum(lo <= x < hi for x in at[:m]) - m * (hi - lo) / n) < 4


def slow_fingerprint(t):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(n, linked):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, none):
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs).collect())
    rows = sorted((i, slow_fingerprint(t)) for i, t, *_ in ROWS)
    top = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 4])
    assert got == sorted((i, f, rows[top[k]][0]) for k, (i, f) in enumerate(rows))
    assert simhash.simhash_components(none).count() == 0


def test_vantage_tree_loses_no_link(spark):
    fps = R.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([fps ^ np.uint64(sum(1 << int(b) for b in R.choice(64, k, replace=False))) for k in (1, 3, 4, 5)] + [np.full(1, 7, np.uint64) ^ np.uint64(1 << i) for i in range(60)])
    every = np.unique(np.concatenate((fps, near)))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    got = simhash.links(df, leaf=10, block=64, sample=512).collect()
    index = {int(x): i for i, x in enumerate(every.view(np.int64))}
    want = groups(len(every), [(i, j) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every[:i] ^ every[i]) <= 4)])
    assert groups(len(every), [(index[r.a], index[r.b]) for r in got]) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1051)}) == 1 and got[0] != got[1000] and 5000 not in got


def test_media(docs, none, tmp_path):
    media.store_texts(docs, f"file://{tmp_path}/m")
    got = sorted(tuple(r) for r in media.media_features(docs.sparkSession.read.parquet(f"file://{tmp_path}/m")).collect())
    assert len(got) == len(ROWS)
    for i, n, size, sha, tail, stored, _, feature, *_ in got:
        fits = [p for j, t, *_ in ROWS if j == i and len(b := (t or "").encode()) == n for p in [b + b"\xff" * (-len(b) % 576 if b else 576)]]
        assert any((size, sha, tail, stored) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(p) + 44) for p in fits)
        assert feature.startswith("audio/wav")


def test_sniffing_corrects_and_carves(spark):
    import gzip
    import struct

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    gz = gzip.compress(b"hello" * 9)
    broken = png[:-3] + b"abc"
    values = {"png": png, "both": b"BM junk " + gz + b"zz" + png, "broken": broken, "text": b"RIFF BM GIF89a PK\x03\x04 %PDF-", "empty": b"", "null": None}
    df = spark.createDataFrame([(k, v, "image/jpeg") for k, v in values.items()], "k string, v binary, d string")
    got = {r.key: r for r in media.sniff_media(df, "k", "v", "d").collect()}
    assert got["png"].media_type == "image/png" and got["png"].wrong_type
    assert [(m.type, bytes(m.bytes)) for m in got["both"].media] == [("application/gzip", gz), ("image/png", png)]
    assert all(got[k].n_media == 0 for k in ("broken", "text", "empty", "null"))


def brute_spans(rows, n=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            first[b[s : s + n]] = min(first.get(b[s : s + n], i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < i:
                gone[s : s + n] = True
        out.append((i, len(b), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def test_suffix_dedup(docs, none, spark):
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == brute_spans(ROWS)
    assert suffix_dedup.suffix_dedup(none).count() == 0
    odd = spark.createDataFrame([(None, BASE[0]), (3, BASE[0])], "doc_id long, text string")
    assert all(len(r.spans) == 0 for r in suffix_dedup.suffix_dedup(odd).collect())


def test_suffix_order_with_queues_in_files():
    for trial in range(60):
        parts = [R.integers(1, 2 + trial % 3, R.integers(1, 30)) for _ in range(R.integers(1, 7))]
        t = np.concatenate([np.append(p, 0) for p in parts])
        zero = np.flatnonzero(t == 0)
        order = induced.suffix_order(t, limit=5 if trial % 2 else 1 << 20)
        keys = [tuple(t[i : zero[np.searchsorted(zero, i)] + 1]) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)


def test_token_files(docs, none, spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    folder = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, folder, P.path("word_bpe_49k.json"), file_ids=200)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder).collect())
    assert [i for _, i, *_ in got] == sorted(i for i, *_ in ROWS)
    want, at = {(i, (ids := np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")).size, zlib.crc32(ids.tobytes())) for i, t, *_ in ROWS}, 0
    for start, i, n, crc in got:
        assert start == at and (i, n, crc) in want
        at += n
    ids = R.integers(0, 2**24, 3000)
    f = token_files.TokenFile(token_files.pack_file([5, None], np.array([1000, 2000]), ids))
    assert f.known.tolist() == [True, False] and (f.ids() == ids).all() and all(f.token(i) == ids[i] for i in range(0, 3000, 7))
    assert token_files.write_token_files(none, f"file://{tmp_path}/e", P.path("word_bpe_49k.json")).count() == 0


def test_bpe(docs, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect())
    assert got == sorted((i, (ids := lib.encode(t or "", add_special_tokens=False).ids), lib.decode(ids, skip_special_tokens=False)) for i, t, *_ in ROWS)
    own = bpe.PrefixBPE(P.path("byte_bpe_50k.json"), P.PATTERN)
    letters = list("aabbtheéß  \n\t.,!'\"019世😀\x1c\x85​\xa0")
    for _ in range(400):
        t = "".join(R.choice(letters, R.integers(0, 50)))
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert bpe.encode_documents(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_crf_is_forward_backward():
    import itertools

    m = toxicity.ToxicModel(chain=np.array([-2.0, 1.5, 0.3, -0.7, 0.9]))
    b, s, u, d, st = m.chain
    x = np.array([0, 0, 2.0, 0, 1.0, 3.0, 0])
    total, p = 0.0, np.zeros(7)
    for y in itertools.product((0, 1), repeat=7):
        e, last = 0.0, 0
        for t, v in enumerate(y):
            e += [[0, u], [d, st]][last][v] + (b + s * x[t]) * v
            last = v
        total += np.exp(e)
        p += np.exp(e) * np.array(y)
    at = np.flatnonzero(x)
    assert np.allclose(m.marginals(at, x[at], 7), p[at] / total)
    for toxic in (True, False):
        gold = 0.0
        for i, last in zip(range(7), [0, *(x[:-1] > 0).astype(int) * toxic]):
            v = int(toxic and x[i] > 0)
            gold += [[0, u], [d, st]][last][v] + (b + s * x[i]) * v
        rows = toxicity.TokenRows.of([(at, x[at], 7)], np.array([toxic]))
        assert abs(rows.likelihood(m.chain) - (gold - np.log(total))) < 1e-9
    many = [(np.flatnonzero(v), v[np.flatnonzero(v)], len(v)) for v in (R.integers(0, 2, k) * 2.0 for k in (1, 5, 9, 30, 0))]
    apart = sum(toxicity.TokenRows.of([t], np.array([k % 2 == 0])).likelihood(m.chain) for k, t in enumerate(many))
    assert abs(toxicity.TokenRows.of(many, np.arange(5) % 2 == 0).likelihood(m.chain) - apart) < 1e-9


def test_toxicity_learns(spark, docs, none):
    bad = ["vile", "rotten"]
    rows = [(i, text(20) + (" vile slug rotten slug " if i % 4 == 0 else " ") + text(20)) for i in range(400)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(own, labels)
    got = {r.doc_id: r for r in toxicity.score(own, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i].score >= 0.3) == (i % 4 == 0) for i in held)
    t = dict(rows)[0]
    assert {t[s.start : s.end] for s in got[0].offending} >= set(bad)
    assert {r.score for r in toxicity.score(docs.where("text is null or text = ''"), model).collect()} == {model.score_of(*model.active(""))}
    assert toxicity.fit(none, labels).score_of(*model.active("vile")) < 1e-9
    assert toxicity.reject(own, model).count() == 300


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 8))
    rows = [(int(i), (base[i % 30] * (1 + i % 3) + r.normal(size=8) * 0.12).tolist(), 0) for i in range(200)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 8, 1), (1003, [1.0, None] + [0.0] * 6, 1), (1004, [float("nan")] * 8, 1), (1005, rows[3][1], 1), (1005, rows[3][1], 1), (1006, [1.0] * 4, 1), (1007, [2.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    link = lambda a, b: ok(a) and ok(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9 - 1e-12
    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(i) if link(rows[i][1], rows[j][1])]
    top, count = groups(n, pairs), [0] * n
    for i, j in pairs:
        count[i] += 1
        count[j] += 1
    least = lambda i: min((rows[k][0] for k in range(n) if top[k] == top[i] and rows[k][0] is not None), default=None)
    want = sorted(((rows[i][0], count[i], least(i), rows[i][0] == least(i)) for i in range(n)), key=str)
    for how in ({}, {"pivots": 3, "block": 16}):
        assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in embeddings.embedding_links(df, **how).collect()), key=str) == want
    assert embeddings.embedding_links(df.limit(0)).count() == 0


def test_token_counts(docs, none, spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert token_counts.commit(folder, "1", token_counts.changes(docs, "w", F.char_length("text")))
    assert not token_counts.commit(folder, "1", token_counts.changes(docs, "w", F.char_length("text")))
    assert token_counts.commit(folder, "2", token_counts.changes(docs.where("doc_id < 5"), "w", F.char_length("text"), -1))
    assert token_counts.commit(folder, "3", token_counts.changes(none, "w", F.char_length("text")))
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.totals(spark, folder, ["1", "2", "3", "missing"]).collect()}
    for key in {(s, lang) for _, _, lang, s in ROWS}:
        own = [t or "" for i, t, lang, s in ROWS if (s, lang) == key and i >= 5]
        assert got[key] == (len(own), sum(map(len, own)))
    one = token_counts.compact(spark, folder, ["1", "2", "3"], "all")
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in one.collect()} == got
    for named in (None, ["1", "2", "3", "all"]):  # what is folded counts once
        assert {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.totals(spark, folder, named).collect()} == got
    assert not token_counts.commit(folder, "2", token_counts.changes(docs, "w", F.char_length("text")))
    token_counts.commit(folder, "4", token_counts.changes(docs, "w", F.char_length("text")))
    token_counts.compact(spark, folder, ["all", "4"], "later")
    both = {(r.source, r.lang): r.docs for r in token_counts.totals(spark, folder).collect()}
    assert both == {k: v[0] + sum((s, g) == k for _, _, g, s in ROWS) for k, v in got.items()}
    assert token_counts.totals(spark, f"{folder}-none").count() == 0


def test_quality(spark, docs, none):
    rows = [(i, text(30) if i % 3 else "!!! ### ".join(["x"] * 20), f"h{i % 5}", "p") for i in range(300)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    w = quality.fit(own, labels)
    got = {r.doc_id: r.keep for r in quality.quality_scores(own, w, F.col("source"), F.col("lang")).collect()}
    assert np.mean([got[i] == (i % 3 > 0) for i in range(200, 300)]) > 0.95
    assert quality.quality_scores(docs, w, F.col("source"), F.col("lang")).count() == len(ROWS)
    assert quality.quality_scores(none, w, F.col("source"), F.col("lang")).count() == 0
    urls = spark.createDataFrame([("https://www.A.example/b/c",), ("not a url",), (None,)], "u string")
    assert urls.select(quality.url_site(F.col("u")), quality.url_path(F.col("u"))).first()[:] == ("a.example", "b")


def test_quality_posteriors(spark):
    """Shrunk rates of hosts and paths against the same sums in Python."""
    rows = [(k, s, p, float(R.normal(1.5 if s == "good" else -0.5))) for k, (s, p) in enumerate([("good", "a")] * 40 + [("good", None)] * 3 + [("bad", "a")] * 30 + [("bad", "b")] * 25 + [(None, "a")] * 2)]
    own = spark.createDataFrame([(k, s, p, x) for k, s, p, x in rows], "doc_id long, site string, path string, evidence double")
    got = {(r.site, r.path): r for r in quality.site_posteriors(own.select("site", "path", "evidence")).collect()}
    prob = lambda x: 1 / (1 + np.exp(-x))
    mean = np.mean([prob(x) for *_, x in rows])

    def strength(groups):  # (n, sum, prior mean)
        v = sum(n * ((s / n - m) ** 2 - m * (1 - m) / n) for n, s, m in groups) / sum(n for n, *_ in groups)
        c = np.mean([m * (1 - m) for *_, m in groups])
        return float(np.clip(c / v - 1 if v > 1e-9 else 1e6, 1, 1e6))

    def total(keep):
        xs = [prob(x) for _, s, p, x in rows if keep(s, p)]
        return len(xs), sum(xs)

    sites = {s: total(lambda a, _, s=s: a == s) for s in ("good", "bad", None)}
    k = strength([(n, s, mean) for n, s in sites.values()])
    rate = {s: (x + k * mean) / (n + k) for s, (n, x) in sites.items()}
    paths = {key: total(lambda a, b, key=key: (a, b) == key) for key in got}
    for key, (n, x) in paths.items():
        assert got[key].n == n and abs(got[key].s - x) < 1e-9 and abs(got[key].rate - rate[key[0]]) < 1e-9
    k2 = strength([(n, x, rate[key[0]]) for key, (n, x) in paths.items()])
    assert all(abs(r.path_k - k2) < 1e-6 and abs(r.global_rate - mean) < 1e-12 for r in got.values())


def test_page_text(spark):
    html = "<html><head><style>p{a}</style><script>x='<p>'</script></head><!-- <b> --><body>One <b>two</b>\nthree"
    assert spark.createDataFrame([(html,), (None,)], "h string").select(quality.page_text(F.col("h")).alias("t")).collect()[0].t.split() == ["One", "two", "three"]
