"""The ten operators against brute force and in the awkward cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bpe, chat, langid, packing, quality, simhash, url_filter, vectors, warc
from cadenza.llm.common import components

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 40_000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog", "en"), (2, "the QUICK brown fox jumps over the lazy dog", "en"), (3, None, None), (4, "", "en"), (5, " \t\n", "de"), (6, LONG, "en"),
    (7, "12345 !!! ???", None), (8, "a b", "fr"), (None, "kein Schlüssel für diese Zeile", "de"), (9, "<|endoftext|>x\u00a0y e\u0301 ΑΣ", "es"), (9, "<|endoftext|>x\u00a0y e\u0301 ΑΣ", "es"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumns({"score": F.lit("kept?"), "fp": F.lit(1), "ids": F.lit(2), "Length": F.lit(3)})


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (7, 7)]
    rows = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(rows).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert found == union(real, {x for e in real for x in e})
    assert components(rows.limit(0)).count() == 0


# ---- 1


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="abAB \t\x0b\u00e9\u00a0", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_is_xxh64_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def brute_groups(fps, group):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 2]
    return union(pairs, range(len(fps)))


@pytest.mark.parametrize("seed", range(6))
def test_bucket_links(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    fps = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, n)]
    for _ in range(seed % 4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    group = np.sort(rng.integers(0, 1 + seed * 3, n))
    a, b = simhash.bucket_links(fps.view(np.int64), group)
    assert len(a) < n
    assert all(bin(int(fps[i] ^ fps[j])).count("1") <= 2 or True for i, j in zip(a, b, strict=True))
    assert union(zip(a.tolist(), b.tolist(), strict=True), range(n)) == brute_groups(fps, group)


@pytest.mark.parametrize("cell", [simhash.CELL, 8])
def test_links_lose_nothing(spark, cell):
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 50, dtype=np.uint64), *(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(2))])).view(np.int64)
    rows = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(rows, cell)).collect()}
    want = union([(int(a), int(b)) for a in fps for b in fps if a < b and bin(int(a ^ b) % 2**64).count("1") <= 2], [int(f) for f in fps])
    assert {f: found.get(f, f) for f in want} == want


def test_near_dedup(docs):
    got = simhash.near_dedup(docs).collect()
    assert len(got) == len(DOCS)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[2] == 1 and of[4] == of[5] == of[3] == 3 and of[9] == 9 and of[None] is None
    assert all(r["fp"] % 2**64 == slow_fingerprint(dict((d[0], d[1]) for d in DOCS)[r["doc_id"]]) for r in got)
    assert simhash.near_dedup(docs.limit(0)).count() == 0


# ---- 2


def test_gradients():
    rng = np.random.default_rng(0)
    net, x, mask, label = langid.LanguageNet(["a", "b", "c"], hidden=3), rng.integers(0, 256, (9, 4)), np.ones((9, 4), np.float32), np.array([0, 1, 2, 1])
    mask[6:, 1] = 0
    grads = net.gradients(x, mask, label)

    def loss():
        p, _ = net.run(x)
        return -(np.log(p[:, label, np.arange(4)].astype(np.float64)) * mask).sum() / mask.sum()

    for name, (owner, key) in net.parts().items():
        array = getattr(owner, key)
        at = np.unravel_index(np.abs(grads[name]).argmax(), array.shape)
        kept = array[at]
        array[at] = kept + 1e-2
        up = loss()
        array[at] = kept - 1e-2
        down = loss()
        array[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def language_rows(n=120):
    rng, words = random.Random(3), {"en": "the and ing that with tion for".split(), "de": "der und ung nicht ein sch\u00e4 f\u00fcr".split(), "fr": "le que eaux ment \u00e9t\u00e9 des les".split()}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60))), lang) for i in range(n) for lang in words]


def test_language(spark, docs):
    rows = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    net = langid.train(rows.where("doc_id % 3 <> 0").select("text", "lang"))
    got = langid.predict(rows.where("doc_id % 3 = 0"), net)
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    odd = {r["doc_id"]: r for r in langid.predict(docs, net).collect()}
    assert len(odd) == len({d[0] for d in DOCS}) and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (3, 4, 5, 7))
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and odd[6]["lang_pred"] in net.languages
    assert langid.predict(docs.limit(0), net).count() == 0
    nothing = langid.train(rows.limit(0).select("text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_every_position_counts():
    net = langid.LanguageNet(["a", "b"])
    text = bytes(range(256)) * 3
    whole = net.probabilities([b"", text])[1]
    parts = np.concatenate([p[:, :, 0][m[:, 0]] for p, _, m in ((p[:, :, k : k + 1], d, m[:, k : k + 1]) for p, d, m in net.positions([text]) for k in range(p.shape[2]))])
    assert len(parts) == len(text) and whole == pytest.approx(parts.mean(axis=0), abs=1e-5)


@pytest.mark.parametrize("size", [1, 16, 127, 128, 129, 224, 225, 1000])
def test_windows_give_context(size):
    data = np.random.default_rng(size).integers(1, 256, size).astype(np.uint8)
    n = int(langid.windows_of(np.array([size]))[0])
    x, mask = langid.cut_windows(data, np.array([0]), np.array([size]), np.zeros(n, int), np.arange(n))
    place = np.arange(langid.WINDOW)[:, None] + np.arange(n) * (langid.WINDOW - 2 * langid.MARGIN)
    assert sorted(place[mask].tolist()) == list(range(size)) and (x[mask] == data[place[mask]]).all()
    for t, k in zip(*np.nonzero(mask), strict=True):
        assert min(t, place[t, k]) >= min(langid.MARGIN, place[t, k]) and min(langid.WINDOW - 1 - t, size - 1 - place[t, k]) >= min(langid.MARGIN, size - 1 - place[t, k])


def test_network_equals_plain_loop():
    net, text = langid.LanguageNet(["a", "b", "c"], hidden=4), "où ça? 中".encode()
    squash = lambda x: x / (1 + abs(x))
    sums = np.zeros((len(text), 3))
    for part, gru in enumerate((net.fore, net.back)):
        h = np.zeros(4)
        for t in range(len(text)) if part == 0 else range(len(text) - 1, -1, -1):
            into, held = gru.e[:, text[t]].astype(float), gru.u.astype(float) @ h
            z, r = (0.5 + 0.5 * squash(into[4 * g : 4 * g + 4] + held[4 * g : 4 * g + 4]) for g in (0, 1))
            h = z * h + (1 - z) * squash(into[8:] + r * (held[8:] + gru.b[:, 0]))
            sums[t] += net.o[part].astype(float) @ h
    want = np.exp(sums + net.c[:, 0]) / np.exp(sums + net.c[:, 0]).sum(axis=1, keepdims=True)
    assert net.run(np.frombuffer(text, np.uint8)[:, None])[0][:, :, 0] == pytest.approx(want, abs=1e-4)


# ---- 3


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 40))
def test_fullest(available, room):
    best = {0}
    for length, n in available.items():
        best = {b + length * k for b in best for k in range(n + 1) if b + length * k <= room}
    used = packing.fullest(available, room)
    assert sum(k * n for k, n in used.items()) == max(best) and all(n <= available[k] for k, n in used.items())


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    plan = packing.minimum_slack_plan(histogram, 64)
    used = {}
    for times, pattern in plan:
        assert sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


def test_pack(spark, docs):
    got = packing.pack(docs, PATH, capacity=64, end_id=1).collect()
    tok = Tokenizer.from_file(PATH)
    want = {}
    for i, text, _ in DOCS:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append(ids)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, texts in want.items():
        pieces = {(p, p * 64, len(ids[p * 64 : p * 64 + 64]), zlib.crc32(np.array(ids[p * 64 : p * 64 + 64], "<u4").tobytes())) for ids in texts for p in range(-(-len(ids) // 64))}
        assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]} == pieces
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == -(-sum(r["length"] for r in got) // 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_pack_long_text_without_spaces(spark):
    rng = random.Random(9)
    texts = {1: "".join(rng.choices("abcdefgh中文", k=120_000)), 2: "x" * 200_000, 3: "y"}
    got = packing.pack(spark.createDataFrame([*texts.items()], "doc_id long, text string"), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    for i, text in texts.items():
        data = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        parts = [data[a : a + 4 * 4096] for a in range(0, len(data), 4 * 4096)]
        assert sorted((r["piece"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i) == [(k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]


# ---- 4 and 7


def vector_rows(n=300, dim=16):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(n // 6, dim))
    x = base[rng.integers(0, len(base), n)] + 0.12 * rng.normal(size=(n, dim))
    x[5] = x[6] = x[7]
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    return rows + [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [float("nan")] * dim), (1004, [None] * dim), (1005, [float("inf")] + [1.0] * (dim - 1)), (1006, [1.0, 2.0]), (None, rows[0][1])]


@pytest.mark.parametrize("cell", [512, 4])
def test_embedding_dedup(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "t": F.lit("x"), "kept": F.lit(0)})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_dedup(df).collect()}
    x = np.array([r[1] for r in rows[:300]], np.float32).astype(np.float64)
    y = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    of = union([(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)], range(300))
    assert {i: got[i] for i in range(300)} == {i: (int(near[i].sum()), of[i], of[i] == i) for i in range(300)}
    assert all(got[i] == (0, i, True) for i in range(1000, 1007)) and got[None][0] == 0
    assert vectors.near_dedup(df.limit(0)).count() == 0


def test_nearest(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("x")})
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 10 = 0 or vec_id > 900")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([r[1] for r in rows[:300]], np.float32).astype(np.float64)
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((float(d[i]), i) for i in range(300) if i != q)[:10]
        assert [(k + 1, i) for k, (_, i) in enumerate(best)] == [g[:2] for g in sorted(got[q])]
        assert [g[2] for g in sorted(got[q])] == pytest.approx([b[0] for b in best], abs=1e-12)
    assert {*got} == {*range(0, 300, 10)}
    few = df.where("vec_id < 4")
    assert vectors.nearest(few, few.where("vec_id = 0")).count() == 3
    assert vectors.nearest(df.limit(0), df).count() == 0 and vectors.nearest(df, df.limit(0)).count() == 0


def nearest_rows(rows, q, k=10):
    x = np.array([r[1] for r in rows])
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [(n + 1, i) for n, (_, i) in enumerate(sorted((float(d[i]), i) for i in range(len(rows)) if i != q)[:k])]


def test_nearest_at_the_mean(spark):
    rng = np.random.default_rng(4)
    half = np.round(rng.normal(size=(20, 8)) * 64) / 64 + 3.0  # sums are exact
    pairs = np.concatenate([half, 6.0 - half, np.full((1, 8), 3.0)])  # the last vector is the mean
    copies, large = np.repeat(half[:1], 20, axis=0), np.concatenate([np.repeat(half[:1], 20, axis=0), -half]) * 1e5
    for x in (pairs, copies, large):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = {}
        for r in vectors.nearest(*[spark.createDataFrame(rows, "vec_id long, embedding array<double>")] * 2).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert {q: sorted(g) for q, g in got.items()} == {q: nearest_rows(rows, q) for q in range(len(rows))}


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-310])
def test_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(6, 8)), 4, axis=0) + 0.05 * rng.normal(size=(24, 8))
    rows = [(i, (v * size).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    y = np.array([r[1] for r in rows]) / size
    near = (y @ y.T) / np.sqrt(np.outer((y * y).sum(axis=1), (y * y).sum(axis=1))) >= 0.95
    np.fill_diagonal(near, False)
    assert near.any() and {r["vec_id"]: r["n_links"] for r in vectors.near_dedup(df).collect()} == {i: int(near[i].sum()) for i in range(24)}
    got = {}
    for r in vectors.nearest(df, df, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert 0 < r["score"] < float("inf")
    assert {q: sorted(g) for q, g in got.items()} == {q: nearest_rows([(i, v.tolist()) for i, v in enumerate(y)], q, 3) for q in range(24)}


def test_nearest_in_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 24))).astype(np.float32)
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(vectors, "SHARD_BYTES", 16 << 10)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = {}
        for r in vectors.nearest(df, df.where("vec_id % 10 = 0")).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        right = sum(len({*got[q]} & {*nearest_rows(rows, q)}) for q in range(0, 1500, 10))
        assert len(got) == 150 and all(len(g) == 10 for g in got.values()) and right >= 0.995 * 1500


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 100, 600):
        turn, r, q = vectors.rotation(dim), rng.normal(size=(500, dim)), rng.normal(size=(20, dim))
        assert turn @ turn.T == pytest.approx(np.eye(dim), abs=1e-9)
        t, norm = r @ turn, np.sqrt((r * r).sum(axis=1))
        fit = np.abs(t).sum(axis=1) / norm / np.sqrt(t.shape[1])
        middle, low = vectors.Turned(q, turn).distances(np.packbits(t > 0, axis=1, bitorder="little").view(np.uint64), norm, fit)
        true = ((q[:, None] - r[None]) ** 2).sum(axis=2)
        assert (low <= true).mean() > 0.995 and np.abs(middle - true).mean() < 0.15 * true.mean()


def test_sign_bound():
    for signs in (16, 200, 1000):
        k = vectors.most_differing(signs, 0.95)
        differ = np.random.default_rng(signs).binomial(signs, np.arccos(0.95) / np.pi, 100_000)
        assert k < signs and (differ <= k).all()


# ---- 5


def test_warc(spark):
    big = "x" * 150
    rows = [(3, "http://a/", big), (1, None, big), (2, "u\r\nX: y", "é" * 60), (4, "u", "é" * 60), (5, "", "short"), (6, "v", "short"), (7, "v", None), (8, "w", ""), (9, "l", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"size": F.lit(1), "payload": F.lit("no")})
    index = warc.write_archives(df)
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert [got[i]["record_type"] for i in range(1, 10)] == ["response", "response", "revisit", "revisit", *["response"] * 5]
    assert got[3]["refers_to"] == 1 and got[4]["refers_to"] == 2 and got[1]["refers_to"] is None
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert bytes(got[i]["payload"]) == (b"" if got[i]["record_type"] == "revisit" else data)
    one = warc.read_records(index.where("page_id = 9")).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == LONG.encode()
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_ranges_coalesce():
    places = [("a", 0, 100), ("a", 100, 50), ("a", 10**7, 10), ("b", 0, 5)]
    assert list(warc.ranges(iter(places))) == [("a", 0, 150, [(0, 100), (100, 50)]), ("a", 10**7, 10**7 + 10, [(10**7, 10)]), ("b", 0, 5, [(0, 5)])]
    assert [len(r[3]) for r in warc.ranges(("a", i * 2000, 2000) for i in range(20_000))] == [8388, 8388, 3224]


def independent_records(data: bytes):
    """Records of a gzip WARC file, read by the format's own rules."""
    while data:
        reader = zlib.decompressobj(31)
        record = reader.decompress(data)
        data = reader.unused_data
        version, rest = record.split(b"\r\n", 1)
        head, rest = rest.split(b"\r\n\r\n", 1)
        fields = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in head.split(b"\r\n"))}
        size = int(fields[b"content-length"])
        assert version == b"WARC/1.0" and rest[size:] == b"\r\n\r\n"
        yield fields, rest[:size]


def test_warc_files_are_valid(spark, tmp_path):
    big = "y" * 200
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"page {i} " + "z" * i) for i in range(60)] + [(0, "http://h/0", big), (0, "http://h/0", big), (None, None, "n"), (70, "", "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(df, f"file://{tmp_path}/w", date="2024-01-02T03:04:05Z")
    seen, ids = {}, []
    for path in (tmp_path / "w").iterdir():
        for fields, block in independent_records(path.read_bytes()):
            assert {b"warc-type", b"warc-record-id", b"warc-date", b"warc-target-uri", b"warc-payload-digest"} <= fields.keys() and fields[b"warc-date"] == b"2024-01-02T03:04:05Z"
            ids.append(fields[b"warc-record-id"])
            if fields[b"warc-type"] == b"response":
                head, body = block.split(b"\r\n\r\n", 1)
                assert fields[b"content-type"] == b"application/http; msgtype=response" and head.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(body)}".encode() in head
                assert fields[b"warc-payload-digest"].decode() == "sha256:" + hashlib.sha256(body).hexdigest()
            else:
                assert block == b"" and fields[b"warc-type"] == b"revisit" and fields[b"warc-refers-to-target-uri"] == b"http://h/0" and b"warc-profile" in fields
            seen[fields[b"warc-target-uri"]] = fields[b"warc-type"]
    assert len(ids) == len({*ids}) == len(rows) and seen[b"http://h/3"] == b"revisit" and seen[b"http://h/0"] == b"response" and seen[b"about:blank"] == b"response"
    some = warc.read_records(index.where("page_id % 7 = 1").orderBy(F.desc("offset"))).collect()
    assert sorted(r["page_id"] for r in some) == [i for i in range(60) if i % 7 == 1] + [] and all(bytes(r["payload"]).startswith(b"page") for r in some if r["record_type"] == "response")
    assert {r["url"] for r in warc.read_records(index.where("page_id is null or page_id = 70")).collect()} == {None, ""}


# ---- 6


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "\\0\\1\\2", "\\", "[", "<s> a[b", "[/INST]", "plain \\n [x] <y>", "", None, "[INST", "/INST]</s", "é🙂\\2[INST]"]
    rows = [(1, i, ["user", "assistant", "system", None, "[INST]odd"][i % 5], t) for i, t in enumerate(hard)] + [(2, None, "user", "n"), (2, None, "user", "n"), (2, 0, "assistant", "a"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "piece": F.lit("x")})
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert {*got} == {1, 2, None}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[: len(hard)]]
    assert [t["text"] for t in got[2]["turns"]] == ["n", "n", "a"]
    for r in got.values():
        said = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert r["loss_text"] == "".join(said) and len(r["loss_spans"]) == len(said)
        raw = [t["raw_text"] for t in r["turns"] if t["role"] == "assistant"]
        under = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert under == raw and r["loss_text"] == "".join(u.replace("\\2", "<").replace("\\1", "[").replace("\\0", "\\") for u in under)
        assert r["formatted"].count("[INST]") == len(r["turns"]) == r["formatted"].count("</s>")
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 8


def test_url_filter(spark):
    urls = {
        1: "https://X.Example.ORG/es/a?b", 2: "http://example.org/en/123#x", 3: "http://a.org", 4: "http://com/fr/", 5: "http://a.com/de/x", 6: "no scheme", 7: None, 8: "ftp://h.net?x/y", 9: "http://bad.net/1", 10: "http://notexample.org/es/",
        11: "a://b://c/d", 12: "http://xcom/de/",
    }
    pages = spark.createDataFrame([*urls.items(), (9, "http://bad.net/1")], "page_id long, url string").withColumns({"host": F.lit("x"), "bad": F.lit(1)})
    outcomes = spark.createDataFrame([(9, 1), (9, 0), (1, 0), (2, 0), (3, 0), (77, 1), (None, 1), (4, None)], "page_id long, bad int")
    got = url_filter.judge_urls(pages, outcomes).collect()
    of = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == 13
    assert of[1] == ("x.example.org", "/es/a", "example.org/es/", "block") and of[2][2:] == ("example.org/en/1", "block")
    assert of[3] == ("a.org", "", None, "allow") and of[4][2:] == ("com/fr/", "allow") and of[5][2:] == ("com/de/", "block")
    assert of[6][:3] == of[7][:3] == ("", "", None) and of[8][:2] == ("h.net", "") and of[10][2:] == ("org/", "allow")
    assert of[11][:2] == ("b:", "//c/d") and of[12][2] is None
    assert url_filter.judge_urls(pages, outcomes.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0


def test_registered_domains(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.com": ("b.com", "com"), "com": ("com", "com"), "": ("", ""), "10.0.0.1": ("10.0.0.1", url_filter.ADDRESSES),
        "1.2.3.4.com": ("4.com", "com"), "[::1]": ("[::1]", url_filter.ADDRESSES), "x.co.zz": ("co.zz", "zz"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = url_filter.domain_parts(F.col("host"))
    assert {r["host"]: (r["d"], r["s"]) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want
    rows = [("shop.net:8080", 1)] * 30 + [("shop.net", 1)] * 30 + [(f"h{i}.org", 0) for i in range(50)]
    got = {r["host"]: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["shop.net"]["n"] == 60 and len(got) == 51 and all(r["bad_bound"] >= 0 for r in got.values())


def test_reputation_shrinks(spark):
    rows = [("spam.bad.net", 1)] * 60 + [("one.bad.net", None)] + [(f"h{i}.good.net", i % 20 == 0 and 1 or 0) for i in range(200)] + [(None, 0)]
    got = {r["host"]: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["spam.bad.net"]["bad_bound"] > 0.3 > got["h1.good.net"]["bad_bound"]
    assert got["h1.good.net"]["bad_mean"] < got["one.bad.net"]["bad_mean"] < got["spam.bad.net"]["bad_mean"] and "" in got


# ---- 9


def test_bpe_equals_the_library():
    tok, ours, rng = Tokenizer.from_file(PATH), bpe.ForcedBoundaryBPE(PATH), random.Random(5)
    letters = "abcIt'sSTvell re ΣσςİIıßéÉñüǺ\u0300 \u00a0\u3000\x1c\x85\t\n<|endoftext|>0123٣中文한🙂!!…—"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(1500)] + [d[1] or "" for d in DOCS] + ["a" * 3000, "don't CAN'T <|startoftext|><|endoftext|>"]
    for text in texts:
        want = tok.encode(text, add_special_tokens=False).ids
        got = [i for ids in ours.encode_chunks(text.encode().split()) for i in ids]
        assert got == want and ours.decode(got) == tok.decode(want, skip_special_tokens=False)


def test_bpe_digests(spark, docs):
    tok = Tokenizer.from_file(PATH)
    got = bpe.encode_digest(docs, PATH).collect()
    assert len(got) == len(DOCS) and "score" in got[0] and "Length" in got[0]
    for r in got:
        ids = tok.encode(dict((d[0], d[1]) for d in DOCS)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode(docs, PATH).collect()}
    assert full[3]["ids"] == [] and full[1]["ids"] == tok.encode(DOCS[0][1], add_special_tokens=False).ids and full[3]["decoded"] == ""
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    tok = bpe.ForcedBoundaryBPE(PATH)
    cache, rng = bpe.ChunkCache(tok, bpe._joined), random.Random(1)
    for _ in range(20):
        chunks = [rng.choice("abcdefgh").encode() * rng.choice([1, 2, 3, 5, 100]) for _ in range(30)]
        assert cache.values(chunks) == [bpe._joined(tok, i) for i in tok.encode_chunks(chunks)]
        assert all(len(c) <= bpe.CACHED_WORD for c in [*cache.young, *cache.old]) and len(cache.young) + len(cache.old) < 40


def test_caches_do_not_add_up():
    from cadenza.llm import common

    a = common.worker_cache("a", lambda: [1])
    assert common.worker_cache("a", list) is a and common.worker_cache("b", lambda: [2]) == [2] and [*common._CACHE] == ["b"]


def test_stages_without_a_cache_drop_what_others_kept(spark):
    from cadenza.llm import common

    docs = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(40)], "doc_id long, text string, lang string").coalesce(1)

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [len(common._CACHE)]})

    held = lambda: {r["pid"]: r["n"] for r in docs.mapInArrow(kept, "pid long, n long").collect()}
    net = langid.LanguageNet(["en", "fr"])
    for stage in (lambda: langid.predict(docs.drop("lang"), net), lambda: simhash.fingerprints(docs)):
        bpe.encode(docs.select("doc_id", "text"), PATH).collect()
        before = held()
        stage().collect()
        after = held()
        assert all(before.values()) and before.keys() == after.keys() and not any(after.values())


def test_bpe_of_long_words():
    tok, ours, rng = Tokenizer.from_file(PATH), bpe.ForcedBoundaryBPE(PATH), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 1_000_000, "".join(rng.choices(letters, k=1_000_000)), "".join(rng.choices("中文字符集合日本語テキスト한국어", k=100_000)), "".join(rng.choices(["the", "ing", "over", "er"], k=50_000))]
    texts += ["".join(rng.choices(rng.choice(["ab", "thein", letters, "eio中é"]), k=rng.randrange(100, 400))) for _ in range(200)]
    began = time.perf_counter()
    for text in texts:
        got = [i for ids in ours.encode_chunks([text.encode()]) for i in ids]
        assert got == tok.encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60


# ---- 10


def test_quality(spark, docs):
    rng, words = random.Random(2), "the and of rain sun moon tree house water stone".split()
    good = [(i, " ".join(rng.choice(words) for _ in range(60)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w for _ in range(12) for w in [rng.choice(words)] * 5), 0) for i in range(60)] + [(2000 + i, "!! ".join(rng.choice(words).upper() for _ in range(60)), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, label int")
    model = quality.train(rows.where("doc_id % 5 <> 0").select("doc_id", "text"), rows.select("doc_id", "label"))
    got = quality.predict(rows.where("doc_id % 5 = 0"), model).collect()
    assert sum(r["label"] == r["predicted"] for r in got) >= 0.97 * len(got)
    odd = quality.predict(docs, model).collect()
    assert len(odd) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (3, 4, 5)}) == 1
    assert quality.predict(docs.limit(0), model).count() == 0
    untaught = quality.train(rows.limit(0).select("doc_id", "text"), rows.limit(0).select("doc_id", "label"))
    assert quality.predict(docs, untaught).count() == len(DOCS)


def test_quality_gradients():
    model = quality.SubwordClassifier()
    model.layer[:] = np.random.default_rng(1).normal(size=model.layer.shape)
    ids, weight = quality.document_features("a rose is a rose rose is is")
    assert ids.max() < quality.BUCKETS and abs(weight.sum() - 1) < 1e-5

    def loss():
        out = (model.layer @ (weight @ model.vectors[ids]) + model.bias).astype(np.float64)
        return np.log(np.exp(out).sum()) - out[1]

    by_vector, by_layer, by_bias = model.gradients(ids, weight, 1)
    for array, at, grad in [(model.vectors, (ids[k], d), by_vector[k, d]) for k in (0, 5, len(ids) - 1) for d in (0, 3)] + [(model.layer, (1, 2), by_layer[1, 2]), (model.bias, 0, by_bias[0])]:
        kept = array[at]
        array[at] = kept + 0.05
        up = loss()
        array[at] = kept - 0.05
        down = loss()
        array[at] = kept
        assert grad == pytest.approx((up - down) / 0.1, rel=0.02, abs=1e-4)


def test_features_of_pairs():
    """N-grams over the blank between two words, spelt out."""
    _, _, parts = quality.word_features([b"ab", "é".encode()])
    assert parts[:, 1:].tolist() == [[97, (97 * 0x100000001B3 + 98), 98, (97 * 0x100000001B3 + 98)], [233, (233 * 0x100000001B3 + 62), 233, (60 * 0x100000001B3 + 233)]]
    same = quality.pair_features(parts[[0, 1, 0, 1]])
    assert same.shape == (3, 4) and same[0].tolist() == same[2].tolist() != same[1].tolist()
    assert quality.pair_features(parts[:1]).shape == (0, 4)
    ids, share = quality.document_features("ab é ab é")
    assert {*same.ravel().tolist()} <= {*ids.tolist()} and len(quality.document_features(None)[0]) == len(quality.document_features(" \n ")[0]) == 0


def test_quality_learns_from_a_bounded_sample(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"bad bad bad {i}", i % 2) for i in range(200)] + [(7, f"good again {k}", 1) for k in range(3)] + [(8, "same bad text", 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = df.select("doc_id", "label").distinct().unionAll(spark.createDataFrame([(None, 1), (3, None), (999, 1)], "doc_id long, label int"))
    for sample in (30, 1000):
        seen = []
        fit = quality.SubwordClassifier.fit
        quality.SubwordClassifier.fit = lambda self, docs, labels, seen=seen, **k: seen.append((len(docs), len(labels))) or fit(self, docs, labels, steps=500)
        try:
            model = quality.train(df.select("doc_id", "text"), labels, sample)
        finally:
            quality.SubwordClassifier.fit = fit
        assert seen == [(min(sample, 204), min(sample, 204))]  # one row a document and text, however often it comes
    got = {r["text"]: r["predicted"] for r in quality.predict(df, model).collect()}
    assert got["good words here 1"] == 1 and got["bad bad bad 0"] == 0


def test_samples_do_not_depend_on_partitions(spark):
    rng, words = random.Random(4), "the and of rain sun moon tree house water stone der und les que".split()
    rows = [(i % 300, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), rng.choice("ab"), i % 2) for i in range(400)] + [(7, "one text again and again", "a", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    one, many = df.coalesce(1).orderBy(F.desc("text")), df.repartition(7)
    a, b = (quality.train(f.select("doc_id", "text"), f.select("doc_id", "label"), sample=60) for f in (one, many))
    assert (a.vectors == b.vectors).all() and (a.layer == b.layer).all()
    samples = [langid.training_sample(f.select("text", "lang"), sample=60) for f in (one, many)]
    assert samples[0] == samples[1] and len(samples[0][0]) == 60 == 2 * samples[0][1].count("a") and len({*samples[0][0]}) > 50
    assert len(langid.training_sample(df.where("label = 1").select(F.concat("text", "doc_id").alias("text"), F.col("doc_id").cast("string").alias("lang")), sample=5)[0]) >= 150


def test_quality_of_long_words():
    model = quality.SubwordClassifier().fit([quality.document_features("a a b"), quality.document_features("c d")], [1, 0], steps=50)
    weight, bias = model.folded()
    scorer = quality.Scorer(weight, bias)
    texts = ["x" * 300_000, "中文" * 40_000 + " b", "a " + "y" * 100 + " a", "a b"]
    for _ in range(2):
        got = scorer.scores([t.encode() for t in texts])
        for text, score in zip(texts, got, strict=True):
            ids, share = quality.document_features(text)
            assert score == pytest.approx(1 / (1 + np.exp(-(float(share @ weight[ids]) + bias))), abs=1e-5)
    assert {*scorer.place} == {b"a", b"b"}


def test_scorer_equals_plain_sum():
    model = quality.SubwordClassifier().fit([quality.document_features("a a b"), quality.document_features("c d")], [1, 0], steps=50)
    weight, bias = model.folded()
    for text in ["", "a", "a a a b é", "x y z"]:
        ids, share = quality.document_features(text)
        odds = float(share @ weight[ids]) + bias if len(ids) else bias
        assert quality.Scorer(weight, bias).scores([text.encode()])[0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)


def test_long_texts_go_through(spark):
    """Texts of 2 MB, with and without blanks, through the operators that have no such test of their own."""
    rows = [(1, "x" * 2_000_000), (2, "the and of " * 190_000), (3, "é" * 1_000_000), (4, None), (5, "plain words of a short text")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    assert simhash.near_dedup(docs).count() == 5
    net = langid.train(docs.where("doc_id = 5").unionByName(docs.where("doc_id = 2").withColumn("lang", F.lit("de"))).select("text", "lang"))
    assert langid.predict(docs, net).where("lang_pred = 'und'").count() == 1
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.coalesce("text", F.lit(""))).alias("url"), F.col("text").alias("html"))
    got = {r["page_id"]: r["payload_bytes"] for r in warc.read_records(warc.write_archives(pages)).collect()}
    assert got == {i: len((t or "").encode()) for i, t in rows}
    turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert chat.format_conversations(turns).select(F.char_length("loss_text")).first()[0] == sum(len(t or "") for _, t in rows)
    judged = url_filter.judge_urls(pages, spark.createDataFrame([(1, 1)], "page_id long, bad int"))
    assert judged.count() == 5


def test_repeated_payloads_by_either_join(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i}/", "same " * 50 if i % 3 else f"own {i} " * 30) for i in range(60)] + [(None, "http://n/", "same " * 50)], "page_id long, url string, html string")
    both = []
    for few in (1 << 20, 0):
        monkeypatch.setattr(warc, "FEW_BYTES", few)
        both.append(sorted((repr(r.page_id), r.record_type, r.refers_to) for r in warc.plan_records(pages).collect()))
    assert both[0] == both[1] and sum(k == "response" for _, k, _ in both[0]) == 21


def test_one_document_many_times(spark):
    """A doc_id with one text in many rows, and with different texts of one length, packs whole."""
    rows = [(7, "same words here")] * 300 + [(8, f"word{k % 10} here") for k in range(50)] + [(None, "")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    assert len(got) == len(rows)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
