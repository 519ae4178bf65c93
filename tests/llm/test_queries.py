"""The registered queries and the pipeline over whole tables at the smallest scale, held against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import langid, packing, quality
from cadenza.llm import queries as Q
from cadenza.llm.common import table

from .test_operators import slow_fingerprint, union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def groups(texts):
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    return fps, union([(a, b) for a in texts for b in texts if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2], texts)


def test_op1(spark, texts):
    fps, component = groups(texts)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", component[i]) for i in texts}


def test_op2_held_out(spark, texts):
    got = Q.op2_langid(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.95 * len(unseen)


def packed(rows, texts, tokenizer):
    """Pieces, places and the number of sequences are right."""
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for p, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            r = pieces.pop((i, p))
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    return len(bins)


def test_op3(spark, texts, tokenizer):
    rows = Q.op3_best_fit_packing(spark, SF).collect()
    assert packed(rows, texts, tokenizer) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_op4_and_op7(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    y = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    of = union([(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True)], ids.tolist())
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in Q.op4_embedding_dedup(spark, SF).collect()}
    assert got == {int(i): (int(near[k].sum()), of[int(i)], of[int(i)] == i) for k, i in enumerate(ids)}
    found = {}
    for r in Q.op7_nearest(spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    right = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        d[k] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        right, total = right + len({v for _, v in found[ids[k]]} & {*best}), total + 10
    assert right >= 0.99 * total


def test_op9(spark, texts, tokenizer):
    for r in Q.op9_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10_held_out(spark, texts):
    got = Q.op10_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id", "left").collect()
    assert len(got) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert sum(r["quality"] == r["predicted"] for r in unseen) >= 0.85 * len(unseen)


def test_pipeline_stage_by_stage(spark, texts, tokenizer):
    docs = table(spark, SF, "documents")
    columns, left = docs.columns, {*texts}
    extra = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit("mine"), "lang_pred": F.lit(0)})
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= left
        kept.append((left, now))
        left = now
    # language: what has letters stays, apart from mixtures
    assert len(kept[0][1]) >= 0.97 * sum(any(c.isalpha() for c in t) for t in texts.values())
    # quality: as the classifier says of the whole text
    labels = table(spark, SF, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("quality").alias("label"))
    before = table(spark, SF, "documents").where(F.col("doc_id").isin(*kept[1][0]))
    model = quality.train(before, labels)
    assert kept[1][1] == {r["doc_id"] for r in quality.predict(before, model).where("predicted = 1").collect()}
    # one document of each group
    _, component = groups({i: texts[i] for i in kept[2][0]})
    assert kept[2][1] == {i for i, c in component.items() if i == c}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    packed(rows, {i: texts[i] for i in left}, tokenizer)
    assert corpus_pipeline.classify_quality(spark, extra, SF).columns == extra.columns
    assert corpus_pipeline.identify_language(spark, extra, SF).columns == extra.columns


def test_pipeline_in_awkward_cases(spark):
    rows = [(1, None), (2, ""), (3, "12"), (None, "the and of that is are"), (4, "the and of that is are"), (4, "the and of that is are")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()} <= {None, 4}
    once = corpus_pipeline.remove_near_copies(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in once) == [1, 3, 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_go_by_row(spark):
    fox, other, third = "the quick brown fox jumps", "an entirely different line of words", "wholly unlike anything said before"
    rows = [(None, fox, "en"), (None, fox, "en"), (None, fox.upper(), "en"), (None, other, "de"), (5, third, "en"), (5, "", "en"), (2, "", "en"), (None, third, None), (7, "lone words here", "en"), (7, "lone words here", "en")]
    docs = spark.createDataFrame([(i, t, lang, None, 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.remove_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"].lower()) for r in got.collect()), key=str)
    assert kept == sorted([(None, fox), (None, other), (5, third), (2, ""), (7, "lone words here")], key=str)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == packing.PACKED.replace(" bigint", "").replace(" int", "").split(", ")
    assert langid.UNKNOWN == "und"
