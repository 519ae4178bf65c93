"""Quality classifier over supervised subword embeddings.

A document's features are its words, its word pairs, and its character n-grams, both those inside a word and those over the blank between two words, hashed into BUCKETS rows of a
learned table. The vectors are averaged, a linear layer and a softmax follow, and stochastic gradient descent in numpy trains both on a bounded sample of labelled rows. As the layer is
linear, a trained table folds into one number a bucket, and a word's share is computed once and kept for when the word comes again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, without, worker_cache

#: Rows and length of the table of vectors; lengths of the character n-grams of "<word>".
BUCKETS, DIM, GRAMS = 1 << 18, 8, (2, 3, 4)
#: The training sample is at most so many labelled documents.
SAMPLE_DOCS, STEPS, RATE, LAYER_RATE, BIAS_RATE, SEED = 6000, 32_000, 30.0, 1.0, 0.02, 11
THRESHOLD = 0.3
#: Features a pair of neighbouring words has.
PAIRED = 4
#: Parts in which the driver takes up the sample's features; documents whose features a task holds at once.
FETCHES, FEATURED = 8, 64
#: Distinct words kept in each Python worker, if no longer than CACHED_WORD bytes, and bytes of text worked on at once.
CACHE_WORDS, CACHED_WORD, SLICE_BYTES = 400_000, 64, 1 << 20
PAIR, LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit numbers."""
    x = x * PAIR
    return ((x ^ x >> np.uint64(29)) * PAIR >> np.uint64(64 - 40)).astype(np.int64) % BUCKETS


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of many words at once: the word's number and the bucket of each (the word, then its character n-grams), and what pairs are made of: the
    word's 64-bit hash, its first letter, first two, last and last two, a row a word."""
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    texts = [f"<{w.decode()}>" for w in words]
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(t) for t in texts])
    which, buckets = [np.arange(len(words))], [mixed(own)]
    for n in GRAMS:
        places = max(0, len(letters) - n + 1)
        code = np.full(places, n, np.uint64)
        for k in range(n):
            code = code * LETTER + letters[k : k + places]
        inside = of[:places] == of[n - 1 : n - 1 + places]
        which.append(of[:places][inside])
        buckets.append(mixed(code[inside]))
    end = np.cumsum([len(t) for t in texts], dtype=np.int64)
    start = end - [len(t) for t in texts] if texts else end
    first, last = letters[start + 1], letters[end - 2]
    return np.concatenate(which), np.concatenate(buckets), np.column_stack([own, first, first * LETTER + letters[start + 2], last, letters[end - 3] * LETTER + last])


def pair_features(parts: np.ndarray) -> np.ndarray:
    """Buckets of what neighbouring words make, four a pair: the two words, and the n-grams over their blank with one letter on either side, two before it, two after it."""
    a, b = parts[:-1], parts[1:]
    grams = [((a[:, i] * LETTER + np.uint64(k)) * PAIR + b[:, j]) for k, (i, j) in enumerate(((3, 1), (4, 1), (3, 2)), 7)]
    return np.column_stack([mixed((a[:, 0] * PAIR) ^ b[:, 0]), *map(mixed, grams)]) if len(parts) > 1 else np.zeros((0, PAIRED), np.int64)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and each one's share of all its features; both empty for a text without words."""
    words = (text or "").encode().split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.array([number[w] for w in words], np.int64)
    which, buckets, parts = word_features(list(number))
    times = np.bincount(at, minlength=len(number))[which]
    pairs = pair_features(parts[at]).ravel()
    ids, place = np.unique(np.concatenate([buckets, pairs]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([times, np.ones(len(pairs))]), len(ids))
    return ids, (counts / max(1.0, counts.sum())).astype(np.float32)


class SubwordClassifier:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.layer, self.bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)

    def gradients(self, ids: np.ndarray, weight: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one document's cross-entropy: by the vectors of ``ids``, the layer and the bias."""
        mean = weight @ self.vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
        out = self.layer @ mean + self.bias
        p = np.exp(out - out.max())
        p /= p.sum()
        p[label] -= 1
        return np.outer(weight, p @ self.layer), np.outer(p, mean), p

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS, rate: float = RATE, seed: int = SEED):
        """A gradient step a document, in random order over and over; the rates fall linearly to 0. That of the vectors is large, as a feature's share of a document is small."""
        rng, done = np.random.default_rng(seed), 0
        total = -(-steps // max(1, len(docs))) * len(docs)
        if labels:
            share = (sum(labels) + 1) / (len(labels) + 2)
            self.bias[:] = [np.log(1 - share), np.log(share)]
        while done < total:
            for i in rng.permutation(len(docs)):
                left = 1 - done / total
                done += 1
                ids, weight = docs[i]
                by_vector, by_layer, by_bias = self.gradients(ids, weight, labels[i])
                self.layer -= LAYER_RATE * left * by_layer
                self.bias -= BIAS_RATE * left * by_bias
                if len(ids):
                    self.vectors[ids] -= rate * left * by_vector
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of label 1, and the log-odds of a text without features."""
        return self.vectors @ (self.layer[1] - self.layer[0]), float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores texts with a folded model; a word's sum over its buckets is kept, unless the word is long."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float64), bias
        self._empty()

    def _empty(self):
        self.place = {}
        self.value, self.count, self.parts = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros((1 << 16, 5), np.uint64)

    def _learn(self, words: list[bytes], start: int):
        """Put what ``words`` add at places from ``start`` on."""
        which, buckets, parts = word_features(words)
        while start + len(words) > len(self.value):
            self.value, self.count, self.parts = (np.concatenate([a, np.zeros_like(a)]) for a in (self.value, self.count, self.parts))
        end = start + len(words)
        self.value[start:end] = np.bincount(which, self.weight[buckets], len(words))
        self.count[start:end] = np.bincount(which, minlength=len(words))
        self.parts[start:end] = parts
        return dict(zip(words, range(start, end), strict=True))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = []
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= SLICE_BYTES:
                out.append(self._scores(texts[start : i + 1]))
                start, held = i + 1, 0
        return np.concatenate([*out, self._scores(texts[start:])])

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self._empty()
        per = [t.split() for t in texts]
        words = [w for ws in per for w in ws]
        at = list(map(self.place.get, words))
        if None in at:
            missing = [i for i, v in enumerate(at) if v is None]
            new = dict.fromkeys(words[i] for i in missing)
            self.place |= self._learn([w for w in new if len(w) <= CACHED_WORD], len(self.place))
            once = self._learn([w for w in new if len(w) > CACHED_WORD], len(self.place))  # the next words to learn take their places
            for i in missing:
                w = words[i]
                at[i] = once[w] if len(w) > CACHED_WORD else self.place[w]
        at = np.array(at, np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in per])
        total = np.bincount(doc, self.value[at], len(texts))
        count = np.bincount(doc, self.count[at], len(texts))
        if len(at) > 1:
            inside = doc[1:] == doc[:-1]
            pairs = pair_features(self.parts[at])[inside]
            total += np.bincount(doc[1:][inside], self.weight[pairs].sum(axis=1), len(texts))
            count += PAIRED * np.bincount(doc[1:][inside], minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> SubwordClassifier:
    """Fit on whole texts of at most ``sample`` rows of ``docs(doc_id, text)`` with a label in ``labels(doc_id, label)``, those first by a hash of doc_id.

    The sample is the same however the tables are partitioned: the first ``sample`` labels by the hash, then by doc_id and label, meet their documents, of which the first ``sample``
    by the same order and the text's hash are taken (a repeated doc_id gives several rows, one a text). Null ids and labels are left out; repeated labels count each. What is
    broadcast to the scans of ``docs`` is ``sample`` ids and hashes. Executors turn the texts into features; the driver holds those, at most 12 BUCKETS bytes a document.
    """
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("label")]
    picked = labels.where("label is not null and doc_id is not null").select("doc_id", "label").orderBy(*order).limit(sample)
    named = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id").select("doc_id", F.xxhash64("text").alias("h")).distinct()
    chosen = named.join(F.broadcast(picked), "doc_id").orderBy(*order, "h").limit(sample).toArrow()  # ids, hashes and labels only
    wanted = docs.sparkSession.createDataFrame(chosen.select(["doc_id", "h"])).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id").withColumn("h", F.xxhash64("text"))
    rows = rows.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])

    def features(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, FEATURED):
                some = batch.slice(start, FEATURED)
                made = [document_features(t) for t in some.column("text").to_pylist()]
                columns = [pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("h"), *columns], ["doc_id", "h", "ids", "share"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = materialize(rows.mapInArrow(features, f"doc_id {kind}, h bigint, ids array<int>, share array<float>"), "features")
    held = {}
    for part in range(FETCHES):  # what is on its way through the driver's JVM is a part of it at a time
        got = made.where(F.pmod("h", F.lit(FETCHES)) == part).toArrow()
        keys = zip(got.column("doc_id").to_pylist(), got.column("h").to_pylist(), strict=True)
        held |= dict(zip(keys, zip(_lists(got.column("ids")), _lists(got.column("share")), strict=True), strict=True))
    use = sorted(zip(*(chosen.column(c).to_pylist() for c in ("doc_id", "h", "label")), strict=True))
    return SubwordClassifier().fit([held[d, h] for d, h, _ in use], [int(label) for *_, label in use])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column, without copies."""
    out = []
    for chunk in column.chunks:
        flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def predict(docs: DataFrame, model: SubwordClassifier, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold), or other ``names``, added, from the whole text alone.

    Null text counts as empty; a text without words gets the prior. Rows may repeat; no rows: no rows. Columns of ``docs`` called like an
    output are replaced by it. A map over rows, no shuffle; the model is BUCKETS numbers whatever the data.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    from .bpe import without_collector

    docs = without(docs, names)
    added = [StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())

    def run(batches):
        scorer = worker_cache(hash(shared.value[0].tobytes()), lambda: Scorer(*shared.value))
        with without_collector():
            for batch in batches:
                table = pa.Table.from_batches([batch])
                texts = [t or b"" for t in table.column(text).cast(pa.binary()).to_pylist()]
                score = np.round(scorer.scores(texts), 6)
                table = table.append_column(names[0], pa.array(score)).append_column(names[1], pa.array((score >= threshold).astype(np.int32)))
                yield from table.to_batches()

    return docs.mapInArrow(run, StructType(docs.schema.fields + added))
