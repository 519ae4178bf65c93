"""Language identification by a small bidirectional gated recurrent network over bytes, in numpy.

The network reads UTF-8 bytes, forwards and backwards, and gives every position a distribution over the languages; a document's probabilities are the means
over all positions of its whole text. It reads windows of WINDOW bytes that overlap by two MARGINs: a position is labelled in the window where at least
MARGIN bytes of its text stand on either side (as far as the text goes). It is trained by backpropagation through time on such windows, drawn from anywhere in the whole
texts of a bounded sample of labelled rows. Arrays are laid out (units, lanes), a lane being a window, so that every operation runs over long contiguous rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_caches, without

#: Bytes a window, and of it that only give context, hidden units a direction, windows worked on at once.
WINDOW, MARGIN, HIDDEN, LANES = 128, 16, 8, 1024
#: The training sample: at most so many labelled documents, shared evenly among the languages (one each at least).
SAMPLE_DOCS, STEPS, BATCH, RATE = 4000, 250, 128, 0.02
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Documents predicted at once.
TOGETHER = 2000


def softsign(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + abs(x)) in place: the network's squashing function, far cheaper than tanh. Its slope is the square of 1 - abs(result)."""
    np.abs(x, out=spare)
    spare += np.float32(1)
    x /= spare


def windows_of(sizes: np.ndarray) -> np.ndarray:
    """How many windows cover texts of so many bytes."""
    step = WINDOW - 2 * MARGIN
    return np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // step), (sizes > 0).astype(np.int64))


def cut_windows(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, doc: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window ``nth`` of document ``doc``, for many at once: bytes (WINDOW, windows), 0 beyond the text, and which positions it labels."""
    at, start = np.arange(WINDOW)[:, None], nth * (WINDOW - 2 * MARGIN)
    left = sizes[doc] - start
    x = np.where(at < left, data[np.minimum(begins[doc] + start + at, len(data) - 1)], 0)
    return x, (at < left) & (at >= np.where(nth > 0, MARGIN, 0)) & ((at < WINDOW - MARGIN) | (left <= WINDOW))


class Gru:
    """One direction; gates are (1 + softsign) / 2. ``e`` is (3H, 256): a byte's input to update gate, reset gate and candidate; ``u`` (3H, H) recurrent, ``b`` (H, 1) inside the reset."""

    def __init__(self, rng, hidden: int):
        self.e = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
        self.b = np.zeros((hidden, 1), np.float32)

    def step(self, x, h, room):
        """The next state, and what training needs. ``room`` (two arrays of 3H rows) is written over."""
        n = h.shape[0]
        a, r = room
        self.e.take(x, axis=1, out=a, mode="clip")
        np.matmul(self.u, h, out=r)
        g = a[: 2 * n]
        g += r[: 2 * n]
        softsign(g, r[: 2 * n])
        g *= np.float32(0.5)
        g += np.float32(0.5)
        inner, c = r[2 * n :], a[2 * n :]
        inner += self.b
        c += np.multiply(g[n:], inner, out=r[:n])
        softsign(c, r[:n])
        new = h - c
        new *= g[:n]
        new += c
        return new, (x, h, g, inner, c)

    def grads(self, trace, dh_at):
        """Backpropagation through time: ``dh_at(t)`` is the loss's gradient at step t's state."""
        n = self.b.shape[0]
        de, du, db, dh = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros_like(self.b), 0
        for t in range(len(trace) - 1, -1, -1):
            x, h, g, inner, c = trace[t]
            z, r = g[:n], g[n:]
            dh = dh + dh_at(t)
            da = np.empty((3 * n, len(x)), np.float32)
            da[2 * n :] = dh * (1 - z) * (1 - np.abs(c)) ** 2
            da[:n] = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            da[n : 2 * n] = da[2 * n :] * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dr = da.copy()
            dr[2 * n :] *= r
            for k in range(3 * n):
                de[k] += np.bincount(x, da[k], 256).astype(np.float32)
            du += dr @ h.T
            db += dr[2 * n :].sum(axis=1, keepdims=True)
            dh = dh * z + self.u.T @ dr
        return {"e": de, "u": du, "b": db}


class LanguageNet:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.fore, self.back = languages, Gru(rng, hidden), Gru(rng, hidden)
        self.o = rng.normal(0, 0.3, (2, len(languages), hidden)).astype(np.float32)
        self.c = np.zeros((len(languages), 1), np.float32)

    def run(self, x: np.ndarray, trace: bool = False):
        """``x`` (window, lanes) bytes -> probabilities (window, languages, lanes), and what training needs."""
        steps, lanes = x.shape
        logits = np.empty((steps, len(self.languages), lanes), np.float32)
        hidden, traces, x = self.fore.b.shape[0], ([], []), x.astype(np.intp)
        room = np.empty((2, 3 * hidden, lanes), np.float32)
        for k, (net, order) in enumerate(((self.fore, range(steps)), (self.back, range(steps - 1, -1, -1)))):
            h = np.zeros((hidden, lanes), np.float32)
            for t in order:
                h, kept = net.step(x[t], h, np.empty_like(room) if trace else room)
                if k:
                    logits[t] += self.o[1] @ h
                else:
                    np.matmul(self.o[0], h, out=logits[t])
                if trace:
                    traces[k].append((*kept, h))
        logits += self.c
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, traces

    def parts(self):
        return {"fe": (self.fore, "e"), "fu": (self.fore, "u"), "fb": (self.fore, "b"), "be": (self.back, "e"), "bu": (self.back, "u"), "bb": (self.back, "b"), "o": (self, "o"), "c": (self, "c")}

    def gradients(self, x, mask, label):
        """Gradient of the mean cross-entropy over the positions under ``mask``."""
        p, traces = self.run(x, trace=True)
        d = p
        d[:, label, np.arange(x.shape[1])] -= 1
        d *= (mask / mask.sum())[:, None, :]
        out = {"c": d.sum(axis=(0, 2))[:, None], "o": np.zeros_like(self.o)}
        last = len(x) - 1
        for k, (net, name) in enumerate(((self.fore, "f"), (self.back, "b"))):
            at = (lambda t: t) if k == 0 else (lambda t: last - t)
            for t, kept in enumerate(traces[k]):
                out["o"][k] += d[at(t)] @ kept[-1].T
            g = net.grads([kept[:-1] for kept in traces[k]], lambda t, k=k, at=at: self.o[k].T @ d[at(t)])
            out |= {name + key: v for key, v in g.items()}
        return out

    def fit(self, texts: list[bytes], label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7):
        """Adam over random batches: a document each time, then any of its windows. No text is empty."""
        rng, m, v = np.random.default_rng(seed), {}, {}
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data, begins, counts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, windows_of(sizes)
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(texts), batch)
            x, mask = cut_windows(data, begins, sizes, pick, rng.integers(0, counts[pick]))
            lr = rate * min(1, 2 * (1 - i / (steps + 1)))
            for name, g in self.gradients(x, mask.astype(np.float32), label[pick]).items():
                np.clip(g, -1, 1, out=g)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                owner, key = self.parts()[name]
                getattr(owner, key)[...] -= lr * (m[name] / (1 - 0.9**i)) / (np.sqrt(v[name] / (1 - 0.99**i)) + 1e-7)
        return self

    def positions(self, texts: list[bytes]):
        """For slice after slice of windows: probabilities (window, languages, windows), the windows' documents, and which positions are labelled: each of a text in one window."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data, begins, counts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, windows_of(sizes)
        doc = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        for a in range(0, len(doc), LANES):
            d = doc[a : a + LANES]
            x, mask = cut_windows(data, begins, sizes, d, nth[a : a + LANES])
            yield self.run(x)[0], d, mask

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): means over all positions; empty texts get equal shares."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for p, d, mask in self.positions(texts):
            p *= mask[:, None, :]
            np.add.at(total, d, p.sum(axis=0, dtype=np.float64).T)
            np.add.at(count, d, mask.sum(axis=0))
        return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], 1 / max(1, len(self.languages)))


def training_sample(labelled: DataFrame, sample: int = SAMPLE_DOCS, seed: int = 7) -> tuple[list[bytes], list[str]]:
    """Whole texts and languages of at most ``sample`` distinct rows of ``labelled(text, lang)``, and one of each language at least.

    Every language gives as many, as far as it has them: those first by a hash of the text, whatever the partitions. Rows without a language or a letter are left out. A
    sketch of how many texts a language has bounds what is sorted; copies count once in it. The driver holds those texts whole, and a row for each language.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("text", "lang", F.xxhash64("text", F.lit(seed)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return [], []
    each, whole = max(1, sample // len(counts)), 10**12
    cuts = [(lang, int(whole * min(1, (2 * each + 50) / max(n, 1)))) for lang, n in counts.items()]
    cuts = F.broadcast(labelled.sparkSession.createDataFrame(cuts, "lang string, cut bigint"))  # a row for each language
    some = rows.join(cuts, "lang").where(F.pmod("h", F.lit(whole)) < F.col("cut")).drop("cut").dropDuplicates(["lang", "text"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(whole)), "text"))
    got = some.withColumn("nth", nth).where(F.col("nth") <= each).select("text", "lang", "nth").toArrow().sort_by([("lang", "ascending"), ("nth", "ascending")])
    return got.column("text").cast(pa.binary()).to_pylist(), got.column("lang").to_pylist()


def train(labelled: DataFrame, sample: int = SAMPLE_DOCS) -> LanguageNet:
    """Fit on a bounded sample of ``labelled(text, lang)``. Without a usable row the network knows no language."""
    texts, langs = training_sample(labelled, sample)
    net = LanguageNet(sorted(set(langs)))
    if len(net.languages) > 1:
        net.fit(texts, np.searchsorted(net.languages, langs))
    return net


def predict(docs: DataFrame, net: LanguageNet, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score (or other ``names``) added: the likeliest language by the mean over every position of the whole text, and that mean.

    Null text and text without a letter: ``und`` and score 0, and so is everything where the network knows no language. Ties go to the first language in
    order. Rows may repeat; no rows: no rows. Columns of ``docs`` called like an output are replaced by it. A map over rows, no shuffle.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    docs = without(docs, names)
    added = [StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        drop_caches()
        net = shared.value
        for batch in (whole.slice(first, TOGETHER) for whole in batches for first in range(0, whole.num_rows, TOGETHER)):
            table = pa.Table.from_batches([batch])
            texts = table.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if net.languages and t and LETTER.search(t)]
            p = net.probabilities([texts[i].encode() for i in known])
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known:
                best = p.argmax(axis=1)
                lang[known] = np.array(net.languages, object)[best]
                score[known] = np.round(p[np.arange(len(best)), best], 6)
            yield from table.append_column(names[0], pa.array(lang, pa.string())).append_column(names[1], pa.array(score)).to_batches()

    return docs.mapInArrow(run, StructType(docs.schema.fields + added))
