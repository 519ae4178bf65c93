"""Sharding, whitening and the Merkle manifest against brute force, and in awkward cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle, sharding, whitening
from cadenza.llm import queries as Q
from cadenza.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ---- sharding


def h60(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)


def plain_shards(rows, shards):
    """The same tree by sorting lists; rows equal in everything are told apart by their place."""
    size = [len((r[1] or "").encode()) + 16 for r in rows]
    raw = [(r[0], None if r[3] is None else h60(r[3]), None if r[2] is None else h60(r[2]), r[4]) for r in rows]
    least = [min([c[d] for c in raw if c[d] is not None], default=0) for d in range(4)]
    at = [tuple(least[d] if c[d] is None else c[d] for d in range(4)) for c in raw]
    span = [float(max((c[d] for c in at), default=0) - least[d]) for d in range(4)]
    key = [(0 if r[1] is None else h60(r[1]), h60("".join(f"{'-' if v is None else v}," for v in (r[0], r[3], r[2], r[4])))) for r in rows]
    out = {}

    def cut(held, first, leaves):
        if leaves == 1:
            out.update(dict.fromkeys(held, first))
            return
        width = [(float(max(at[i][d] for i in held) - min(at[i][d] for i in held)) / span[d] if span[d] else 0.0) if held else 0.0 for d in range(4)]
        d = width.index(max(width))
        held = sorted(held, key=lambda i: (at[i][d], *key[i]))
        goal, upto, left = 2 * sum(size[i] for i in held) * (leaves // 2) // leaves, 0, []
        for i in held:
            if 2 * upto + size[i] <= goal:
                left.append(i)
            upto += size[i]
        cut(left, first, leaves // 2)
        cut([i for i in held if i not in {*left}], first + leaves // 2, leaves - leaves // 2)

    cut([*range(len(rows))], 0, shards)
    return [out[i] for i in range(len(rows))], size


AWKWARD = [(1, None, None, None, None), (None, "", "en", "s", 0), (None, "", "en", "s", 0), (2**62, "é" * 500, "en", "s", 500), (-(2**62), "x", "de", None, -3), (7, "long " * 2000, "en", "s", 10_000)]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_equal_plain(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.randrange(50), rng.choice(["copy", "w" * rng.randrange(300)]), rng.choice("abc"), rng.choice(["hot", "hot", f"s{k % 5}", None]), rng.choice([None, k % 7])) for k in range(200)] + AWKWARD
    got = sharding.assign(docs(spark, rows), shards).collect()
    want, size = plain_shards(rows, shards)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.shard) for r in got) == sorted((d[0] is None, d[0] or 0, s, k) for d, s, k in zip(rows, size, want, strict=True))
    for k in range(shards):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == [*range(len(slots))]


def test_shards_in_awkward_cases(spark):
    hot = [(5, "one text", "en", "s", 8)] * 900 + [(6, "other", "de", "t", 5)] * 100
    got = sharding.assign(docs(spark, hot), 10).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 10 and max(r.b for r in got) - min(r.b for r in got) <= 72 and all(r.m == r.n - 1 for r in got)  # equal rows are split where they must be
    copies = [(k, f"text {k % 40}" * 9, "en", "s", 1) for k in range(400)]
    split = sharding.assign(docs(spark, copies), 8, dims=("lang", "source"), keep=("doc_id",)).withColumn("t", F.col("doc_id") % 40)
    assert split.groupBy("t").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() <= 7  # one group of equal texts a cut
    few = sharding.assign(docs(spark, AWKWARD[:3]), 40).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3
    assert sharding.assign(docs(spark, []), 40).count() == 0
    by_bytes = sharding.assign(docs(spark, hot), target_bytes=1000).agg(F.countDistinct("shard")).first()[0]
    assert by_bytes == -(-(900 * 24 + 100 * 21) // 1000)
    clash = docs(spark, AWKWARD).withColumns({c: F.lit("mine") for c in ("size", "shard", "slot", "node", "salt", "by_text", "row", "range", "dim0", "low", "v")})
    assert sharding.assign(clash, 2, keep=("doc_id", "text")).columns == ["doc_id", "text", "size", "shard", "slot"] and sharding.assign(clash, 2).count() == 6


def test_op11(spark):
    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    made = Q.op11_sharding(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    got = made.collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode())) for i, r in rows.items()}
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None} and {r["shard"] for r in got} <= {*range(40)}
    order = [*rows.values()]
    want, _ = plain_shards([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in order], 40)
    assert {r["doc_id"]: r["shard"] for r in got} == {r["doc_id"]: k for r, k in zip(order, want, strict=True)}


# ---- whitening


def plain_whitening(x, most=32):
    x = np.floor(64 * np.array(x, np.float64)) + 1_000_000
    d = x - x.mean(axis=0)
    v = d.T @ d / len(x)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    keep = e > 1e-9 * max(e[0], 1e-300)
    return d @ q[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(v), x


def same_up_to_sign(a, b):
    return all(np.abs(a[:, k] - s * b[:, k]).max() < 1e-6 for k in range(a.shape[1]) for s in [np.sign((a[:, k] * b[:, k]).sum())])


def test_counts_and_eigenvectors():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    values = np.array([9, 5, 5, 5, 2, 1, 1 - 1e-9, 0.5] + [0.1] * 6 + [0.0] * 6)
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    for s in (8, 5.5, 3, 1.5, 0.75, 0.3, 0.05, -1):
        assert whitening.above(a, s) == (values > s).sum()
    e, v = whitening.leading(a, 32)
    assert len(e) == 14 and np.abs(e - values[:14]).max() < 1e-12 and np.abs(v.T @ v - np.eye(14)).max() < 1e-12 and np.abs(a @ v - v * e).max() < 1e-12
    assert len(whitening.leading(np.zeros((3, 3)), 5)[0]) == 0 and whitening.leading(np.ones((4, 4)), 5)[0] == pytest.approx([4])
    assert whitening.above(np.array([[0.0, 1], [1, 0]]), 0) == 1 and whitening.above(np.zeros((2, 2)), 0) == 0


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(None, None, "x"), (900, [1.0, None], "x"), (901, [float("nan")] * 40, "x"), (902, [float("inf")] * 40, "x"), (903, [], "x")]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, whitened string").repartition(5)
    got = whitening.whiten(e).collect()
    w, share, ints = plain_whitening(x)
    assert len(got) == 300 * 32 and {r.n for r in got} == {300} and {r.vec_id for r in got} == {*range(300)}
    made = np.zeros((300, 32))
    for r in got:
        made[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    assert same_up_to_sign(made, w)
    s = ints.astype(int).sum(axis=0)
    assert {r.vec_id: r.deviation for r in got} == {i: sum((300 * int(v) - int(t)) ** 2 for v, t in zip(ints[i], s, strict=True)) for i in range(300)}


def test_whitening_in_awkward_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, [0.5, 1.0])])).count() == 0  # no rows; no covariance
    assert whitening.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    line = whitening.whiten(make([(1, [0.0, 1.0]), (1, [1.0, 1.0]), (None, [2.0, 1.0]), (4, [7.0])])).collect()
    assert len(line) == 3 and {(r.vec_id, round(r.whitened, 9)) for r in line} in ({(1, -1.224744871), (1, 0.0), (None, 1.224744871)}, {(1, 1.224744871), (1, -0.0), (None, -1.224744871)})
    assert all(r.explained == pytest.approx(1) and r.component == 1 for r in line)
    big = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 5.0])]), components=1).collect()
    assert len(big) == 3 and {r.deviation for r in big} == {None, 348160}  # beyond a long
    model = whitening.fit(make([(i, [float(i), float(i * i % 7)]) for i in range(20)]), 2)
    assert whitening.whiten(make([(5, [3.0, 2.0])]), model).count() == 2


def test_op12(spark):
    x = {r["vec_id"]: r["embedding"] for r in table(spark, SF, "embeddings").collect()}
    ids = sorted(x)
    w, share, _ = plain_whitening([x[i] for i in ids])
    got = Q.op12_whitening(spark, SF).collect()
    made = {(r.vec_id, r.component): r for r in got}
    assert len(made) == len(got) == 32 * len(ids) and all(r.identity_error <= 1e-4 for r in got)
    assert same_up_to_sign(np.array([[made[i, k + 1].whitened for k in range(32)] for i in ids]), w)
    assert [made[ids[0], k + 1].explained for k in range(32)] == pytest.approx(share.tolist(), rel=1e-9)


# ---- the Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def encode(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, at, acc):
    way = []
    for nodes in levels[:-1]:
        run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
        way += [n for k, n in enumerate(run) if k != at % 3]
        acc = sha("".join(acc if k == at % 3 else n for k, n in enumerate(run)))
        at //= 3
    return way, acc


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[3] is None else "1" + r[3], []).append((r[0] is not None, r[0] or 0, encode(r), r))
    keys = sorted(groups, key=lambda k: k.encode())
    trees = {k: plain_levels([leaf for *_, leaf, _ in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = plain_levels([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            tamper = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            way, acc = climb(trees[k], at, encode((r[0], r[1].replace("\n", ""), *r[2:])) if tamper else leaf)
            rest, acc = climb(top, g, acc)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], sha("".join(way + rest)), acc, acc == top[-1][0]))
    return out


def altered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def made_manifest(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(df, altered(), proofs=False).collect()]


def test_manifest_equals_plain(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, -(2**63), 2**63 - 1, rng.randrange(-200, 200), rng.randrange(10**12)]), rng.choice([None, "", "a\nb", f"t{k}\n"]), rng.choice(["en", None]), rng.choice([None, "", "s", "é", "z", "\U0001f600"]), rng.choice([None, k])) for k in range(400)]
    rows += [(7, "same\n", "en", "s", 1)] * 50 + [(7, f"other {k}", "en", "s", 1) for k in range(30)]
    got = made_manifest(docs(spark, rows).withColumns({"leaf": F.lit(1), "root": F.lit(2), "key": F.lit("k"), "pos": F.lit(0)}).repartition(6))
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_one_large_group(spark):
    rows = [(k * 3, f"d{k}\n", "en", "hot", k) for k in range(3000)] + [(1, "copy", "en", "hot", 4)] * 5000 + [(1, "lone", "en", "cold", 4)]
    assert sorted(map(repr, made_manifest(docs(spark, rows)))) == sorted(map(repr, plain_manifest(rows)))  # more leaves than a slot array, more copies than a chunk


def test_manifest_in_awkward_cases(spark):
    assert made_manifest(docs(spark, [])) == []
    lone = (3, "x\n", "en", None, 1)
    (got,) = made_manifest(docs(spark, [lone]))
    assert got[1] == got[2] == got[3] == encode(lone) and got[4] == sha("")
    with_proof = merkle.manifest(docs(spark, [lone, (4, "y", "en", None, 1), (5, "z", "en", None, 1)])).orderBy("pos").collect()
    assert with_proof[1]["proof"] == with_proof[0]["leaf"] + with_proof[2]["leaf"] and all(r["verified"] for r in with_proof) and [r["pos"] for r in with_proof] == [0, 1, 2]
    assert len(made_manifest(docs(spark, [(1, "x" * 2_000_000 + "\n", "en", "s", 1), (2, "", "en", "s", 0)]))) == 2


def test_ranks_by_bitmap(spark):
    rng = random.Random(5)
    ids = {rng.choice([rng.randrange(-70, 70), rng.randrange(1 << 20), rng.randrange(-(1 << 63), 1 << 63)]) for _ in range(500)}
    rows = spark.createDataFrame([("g", i, True, bytes(32), None, 1 + (i % 5 == 0)) for i in ids], "key string, id bigint, named boolean, leaf binary, forged binary, copies bigint")
    got = sorted((r.id, r.pos) for r in merkle.ranked(rows).collect())
    want, at = [], 0
    for i in sorted(ids):
        for _ in range(1 + (i % 5 == 0)):
            want.append((i, at))
            at += 1
    assert got == want


def test_op13(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table(spark, SF, "documents").collect()]
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in Q.op13_merkle(spark, SF).collect()]
    assert sorted(got) == sorted(plain_manifest(rows))
