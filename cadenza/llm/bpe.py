"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand next to each other inside no token of the vocabulary can never be merged across. Words are cut there, the
fragments are encoded independently and their ids concatenated. The fragments of many words are encoded at once in numpy: each
round applies, in every short fragment, the merge of the lowest rank (leftmost first). Long fragments, such as a text without white space, are merged
rank by rank instead, each rank at all its places at once, so that their cost grows with n log n.

The vocabulary file is a parameter, never part of this repository. The class takes what the public word-level file declares: NFC, white space to one
space, lower case; words by a pattern; byte-level symbols with an end-of-word mark; two special tokens that are matched in the raw text.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

from .common import worker_cache

SUFFIX = "</w>"
#: Bytes a generation of cached words may take in each Python worker; two generations are kept, and longer words than CACHED_WORD bytes never are.
CACHE_BYTES, CACHED_WORD = 100 << 20, 64
#: Fragments of more bytes are merged rank by rank.
LONG_FRAGMENT = 128
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is visible Latin-1, else the next free one from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] + [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["model"]["end_of_word_suffix"] != SUFFIX:
            raise ValueError(f"{path}: not a word-level byte BPE of the kind this encoder reads")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.space = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        letters = byte_letters()
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.decimal = {i: f"{i} ".encode() for i in self.tokens}
        self.spelled = {i: f"{t} ".encode() for i, t in self.tokens.items()}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + SUFFIX] for c in letters], np.int64)
        of = {c: b for b, c in enumerate(letters)}
        self.joined = np.zeros((256, 256), bool)  # pairs of bytes that some token holds side by side
        for t in vocab:
            body = [of[c] for c in t.removesuffix(SUFFIX)] if t != SUFFIX else []
            self.joined[body[:-1], body[1:]] = True
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made, self.left, self.right = keys[order], order.astype(np.int64), made, left, right
        born = {t: i for i, t in enumerate(made.tolist())}
        if len(born) < len(made) or any(born.get(t, -1) >= i for i, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True)) for t in pair):
            raise ValueError(f"{path}: a token is used before it is made, or made twice")  # merging rank by rank relies on this

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b; NEVER where there is no such merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (normalised, non-empty), one after another, and where each word's ids end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        opens = np.zeros(len(data), bool)
        opens[ends[:-1]] = True
        opens[0] = True
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        cut = opens.copy()
        cut[1:] |= ~self.joined[data[:-1], data[1:]]  # the forced boundaries
        frag = np.cumsum(cut) - 1
        word_of = np.repeat(np.arange(len(words)), sizes)[cut]
        done_frag, done_sym = [], []
        lengthy = (np.bincount(frag) > LONG_FRAGMENT)[frag]
        if lengthy.any():
            sym_of, frag_of = self._merge_by_rank(sym[lengthy], frag[lengthy])
            done_frag.append(frag_of)
            done_sym.append(sym_of)
            sym, frag = sym[~lengthy], frag[~lengthy]
        ranks = np.full(len(sym), NEVER)
        same = frag[:-1] == frag[1:]
        ranks[:-1][same] = self._ranks(sym[:-1][same], sym[1:][same])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            least = np.minimum.reduceat(ranks, starts)
            spread = np.repeat(least, np.diff(np.append(starts, len(sym))))
            over = spread == NEVER
            if over.any():
                done_frag.append(frag[over])
                done_sym.append(sym[over])
                keep = ~over
                sym, frag, ranks, spread = sym[keep], frag[keep], ranks[keep], spread[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(ranks == spread)
            at = hit[np.concatenate(([True], frag[hit[1:]] != frag[hit[:-1]]))]  # the leftmost of each fragment
            sym[at] = self.made[ranks[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, frag, ranks = sym[keep], frag[keep], ranks[keep]
            ranks[at] = NEVER
            fits = at[at + 1 < len(sym)]
            fits = fits[frag[fits] == frag[fits + 1]]
            ranks[fits] = self._ranks(sym[fits], sym[fits + 1])
            fits = at[at > 0]
            fits = fits[frag[fits] == frag[fits - 1]]
            ranks[fits - 1] = self._ranks(sym[fits - 1], sym[fits])
        frag, sym = np.concatenate(done_frag), np.concatenate(done_sym)
        order = np.argsort(frag, kind="stable")
        counts = np.bincount(word_of[frag], minlength=len(words))
        return sym[order], np.cumsum(counts)

    def _merge_by_rank(self, sym: np.ndarray, frag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sym`` with all merges made, and the fragments of what is left.

        A token comes of one merge only, after those that made its parts, so a merge brings up pairs of higher ranks only: each rank's turn comes once. Places
        wait in a heap's order of ranks; those that an earlier merge has changed are passed over.
        """
        n = len(sym)
        after, before, dead = np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        turns: list[int] = []

        def wait(places, following):
            """Pairs at ``places`` wait for their rank's turn."""
            rank = self._ranks(sym[places], sym[following])
            fits = (rank < NEVER) & (frag[places] == frag[following])
            places, rank = places[fits], rank[fits]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))).tolist()
            for a, b in zip(starts, [*starts[1:], len(rank)], strict=True):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(turns, r)
                waiting[r].append(places[a:b])

        wait(np.arange(n - 1), np.arange(1, n))
        while turns:
            r = heapq.heappop(turns)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[~dead[at] & (sym[at] == self.left[r])]
            at = at[after[at] < n]
            at = at[(sym[after[at]] == self.right[r]) & (frag[after[at]] == frag[at])]
            if self.left[r] == self.right[r] and len(at) > 1:  # of overlapping places every second one, from the left
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.made[r]
            dead[gone] = True
            following = after[gone]
            after[at] = following
            inside = following < n
            before[following[inside]] = at[inside]
            previous = before[at]
            some = previous >= 0
            wait(np.concatenate([at[inside], previous[some]]), np.concatenate([following[inside], at[some]]))
        return sym[~dead], frag[~dead]

    def pretokens(self, chunk: str) -> list[bytes | int]:
        """The words of a chunk in UTF-8, and the ids of special tokens in it."""
        if "<|" in chunk:
            parts = self.special_pattern.split(chunk)
            if len(parts) > 1:
                return [y for x in parts if x for y in ([self.special[x]] if x in self.special else self.pretokens(x))]
        if chunk.isascii():
            chunk = chunk.lower()
        else:
            chunk = self.space.sub(" ", unicodedata.normalize("NFC", chunk))
            chunk = "".join(c.lower() for c in chunk) if "\u03a3" in chunk else chunk.lower()  # a final sigma counts as any other
        return [x.encode() for x in self.pattern.findall(chunk)]

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk: a stretch of raw text without ASCII white space. Chunks don't act on each other, as no word holds white space."""
        split = [self.pretokens(c.decode()) for c in chunks]
        words = [w for ws in split for w in ws if w.__class__ is bytes]
        flat, ends = self.encode_words(words)
        flat, bounds, at, out = flat.tolist(), [0, *ends.tolist()], 0, []
        for ws in split:
            n = len(ws)
            if n and any(w.__class__ is int for w in ws):
                ids = []
                for w in ws:
                    if w.__class__ is int:
                        ids.append(w)
                    else:
                        ids += flat[bounds[at] : bounds[at + 1]]
                        at += 1
                out.append(ids)
            else:
                out.append(flat[bounds[at] : bounds[at + n]])
                at += n
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without a decoder does: its tokens, one space between them."""
        return " ".join(self.tokens[i] for i in ids)


def cache_for(path: str, make) -> ChunkCache:
    """This Python worker's encoder and cache for a vocabulary file; they outlive a task, as workers are used again, but not a stage that uses none of them."""
    return worker_cache((path, make), lambda: ChunkCache(ForcedBoundaryBPE(path), make))


class ChunkCache:
    """What ``make`` gives for a chunk's ids, kept for the chunks that come again. Long chunks aren't kept, and what is kept is bounded in bytes."""

    def __init__(self, bpe: ForcedBoundaryBPE, make):
        self.bpe, self.young, self.old, self.held = bpe, {}, {}, 0
        self.make = make

    def _keep(self, chunk: bytes, value) -> None:
        self.young[chunk] = value
        self.held += 160 + len(chunk) + (len(value) if value.__class__ is bytes else sum(48 + len(x) for x in value))  # with what Python adds to each

    def values(self, chunks: list[bytes]) -> list:
        got = list(map(self.young.get, chunks))
        if None in got:
            places = [i for i, v in enumerate(got) if v is None]
            fresh, once = [], {}
            for c in {chunks[i] for i in places}:
                if (v := self.old.get(c)) is None:
                    fresh.append(c)
                else:
                    self._keep(c, v)
            for c, ids in zip(fresh, self.bpe.encode_chunks(fresh), strict=True):
                if len(c) > CACHED_WORD:
                    once[c] = self.make(self.bpe, ids)
                else:
                    self._keep(c, self.make(self.bpe, ids))
            for i in places:
                c = chunks[i]
                got[i] = once[c] if len(c) > CACHED_WORD else self.young[c]
            if self.held > CACHE_BYTES:
                self.young, self.old, self.held = {}, self.young, 0
        return got


@contextlib.contextmanager
def without_collector():
    """Millions of small cached objects and no reference cycles: Python's cycle collector would only walk them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= SLICE_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def chunked(texts: pa.Array) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """For a slice of texts after another: its first row, all its chunks, how many each text has. Null: none."""
    texts = texts.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
    for a, b in slices(sizes):
        per = [(t or b"").split() for t in texts.slice(a, b - a).to_pylist()]
        yield a, [c for cs in per for c in cs], [len(cs) for cs in per]


ENCODED = "ids array<int>, decoded string"


def encode(docs, path: str, text: str = "text"):
    """All columns of ``docs`` but ``text``, with ids array<int> and decoded string of the whole text.

    Null text: as empty, no ids. Rows may repeat; other columns pass through. A column of ``docs`` called like an output is replaced by it.
    Encoding is a map over rows without a shuffle.
    """
    return _mapped(docs, path, text, ENCODED, _encode_batch)


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digest(docs, path: str, text: str = "text"):
    """As ``encode``, but digests in place of ids and decoded text: n_tokens, SHA-256 of the decimal ids (one space between), of the decoded text."""
    return _mapped(docs, path, text, DIGEST, _digest_batch)


def _mapped(docs, path, text, added, work):
    from pyspark.sql.types import StructType

    from .common import without

    new = StructType.fromDDL(added)
    docs = without(docs, [n for n in new.names if n.lower() != text.lower()])
    schema = StructType([f for f in docs.schema.fields if f.name != text] + new.fields)

    def run(batches):
        cache = cache_for(path, _joined)
        with without_collector():
            for batch in batches:
                table = pa.Table.from_batches([batch])
                made = work(cache, table.column(text).combine_chunks())
                for name, column in made.items():
                    table = table.append_column(name, column)
                yield from table.drop_columns([text]).to_batches()

    return docs.mapInArrow(run, schema)


def _joined(bpe, ids) -> tuple[bytes, bytes]:
    """A chunk's ids in decimal and its tokens, a space after each."""
    return b"".join([bpe.decimal[i] for i in ids]), b"".join([bpe.spelled[i] for i in ids])


def _texts(cache, texts):
    for _, chunks, counts in chunked(texts):
        got, at = cache.values(chunks), 0
        for n in counts:
            mine = got[at : at + n]
            at += n
            yield b"".join([x[0] for x in mine])[:-1], b"".join([x[1] for x in mine])[:-1]


def _digest_batch(cache, texts):
    counts, ids, decoded = [], [], []
    for a, b in _texts(cache, texts):
        counts.append(a.count(b" ") + 1 if a else 0)
        ids.append(hashlib.sha256(a).hexdigest())
        decoded.append(hashlib.sha256(b).hexdigest())
    return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}


def _encode_batch(cache, texts):
    made = [(list(map(int, a.split())), b.decode()) for a, b in _texts(cache, texts)]
    return {"ids": pa.array([x[0] for x in made], pa.list_(pa.int32())), "decoded": pa.array([x[1] for x in made], pa.string())}
