"""Whole segments of packed tracks: what ``tiers.whole_segments`` finds by joins of long tables, found in the row that holds a track's words and phones.

A track's tiers never leave it, so nothing is shuffled, sorted or joined: batches of tracks are swept at once in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import tiers as T

#: Tracks swept at once.
AT_ONCE = 2000


def is_marker(label: str) -> bool:
    """This and the following: the Columns of that name in ``tiers`` for one label."""
    return label.strip(" ")[:1] in ("", "<", "{")


def tag(label: str) -> tuple[str, str | None, bool] | None:
    x = label.strip(" ")
    name = re.match("[A-Za-z_]*", x[1:])[0]
    if not x.startswith("<") or not name:
        return None
    inner = x[1 + len(name) :]
    return name.upper(), inner[1:] if inner[:1] in ("-", "=") else None, x.endswith(">")


def disqualifies(label: str | None) -> bool:
    if label is None:
        return False
    found = tag(label)
    return any(stem in label.lower() for stem in T.UNUSABLE) or bool(found and found[1] is not None and "=" in found[1].split(">", 1)[0])


def hidden_words(label: str | None) -> str | None:
    """``recover_hidden_words`` for one label."""
    found = None if label is None else tag(label)
    if not found or found[1] is None or not found[2] or found[0] not in T.SPOKEN_TAGS:
        return None
    words = [w for w in re.split("[_-]", found[1][:-1]) if w]
    return " ".join(words) if words and "=" not in found[1][:-1] else None


def is_sil(label: str) -> bool:
    return label.strip(" ").upper() == "SIL"


def is_nonspeech(label: str) -> bool:
    x = label.strip(" ")
    return is_marker(x) or x.upper() in T.NONSPEECH_PHONES or (x.upper() == x and x.lower() != x)


def is_real_phone(label: str) -> bool:
    first = label.strip(" ")[:1]
    return first.lower() == first and first.upper() != first


def rename_events(label: str) -> str:
    return T.EVENT_NAMES.get(label.strip(" ").upper(), label)


class _Tier:
    """A column of packed intervals as flat arrays; ``timed``: has a start and an end."""

    def __init__(self, column: pa.Array):
        flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        start, end = flat.field("start_us"), flat.field("end_us")
        self.timed = pc.and_(start.is_valid(), end.is_valid()).to_numpy(zero_copy_only=False)
        self.start, self.end = (t.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for t in (start, end))
        self.coded = flat.field("label").cast(pa.string()).dictionary_encode(null_encoding="encode")
        self.distinct, self.codes = self.coded.dictionary.to_pylist(), self.coded.indices.to_numpy(zero_copy_only=False)

    def flags(self, test: Callable[[str], bool]) -> np.ndarray:
        """``test`` of each label, asked once for each distinct one; false for none."""
        return np.array([x is not None and test(x) for x in self.distinct], bool)[self.codes]

    def texts(self, of: Callable[[str], str | None]) -> pa.Array:
        return pa.array([None if x is None else of(x) for x in self.distinct], pa.string()).take(pa.array(self.codes))


def _meetings(s: np.ndarray, e: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, contained: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of spans (row, s, e) and of items (of, start, end) of their row that overlap, or with ``contained`` lie in them but for 1 us: each pair once.

    Rows are moved so far apart that one search serves all. Items lie in order of their starts; those whose running maximum of ends doesn't reach a span are never looked at.
    """
    if not len(s) or not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = min(s.min(), e.min(), start.min(), end.min()) - 2
    room = max(s.max(), e.max(), start.max(), end.max()) - low + 4
    s, e, start, end = s - low + row * room, e - low + row * room, start - low + of * room, end - low + of * room
    order = np.argsort(start, kind="stable")
    starts, ends = start[order], end[order]
    if contained:
        first, last = np.searchsorted(starts, s - 1, "left"), np.searchsorted(starts, e + 1, "right")
    else:
        first, last = np.searchsorted(np.maximum.accumulate(ends), s, "right"), np.searchsorted(starts, e, "left")
    count = np.maximum(last - first, 0)
    span = np.repeat(np.arange(len(s)), count)
    item = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    met = ends[item] <= e[span] + 1 if contained else ends[item] > s[span]
    return span[met], order[item[met]]


def _spans(phones: _Tier, split_us: int) -> dict[str, np.ndarray]:
    """Runs of speech between hard breaks: row, s, e, b and a (silence before and after), last (whether no speech of the track comes later). Phones without label or times are left out."""
    labelled = phones.timed & phones.flags(lambda x: True)
    row, start, end = (x[labelled] for x in (phones.row, phones.start, phones.end))
    sil, event = phones.flags(is_sil)[labelled], phones.flags(lambda x: is_nonspeech(x) and not is_sil(x))[labelled]
    length = np.where(sil, end - start, 0)
    hard = event | (sil & (length >= split_us))
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    run = np.cumsum(fresh | ~sil) - 1  # an interval that is no silence and the silences after it
    upto, total = np.cumsum(length), np.bincount(run, length, minlength=len(row)).astype(np.int64)
    begun = np.flatnonzero(np.diff(run, prepend=-1))
    upto = upto - (upto - length)[begun][run]
    before = np.where(fresh, 0, np.concatenate([[0], upto[:-1]]) if len(row) else upto)
    final = np.zeros(int(row.max(initial=-1)) + 1, np.int64)
    np.maximum.at(final, row, run)
    part = np.flatnonzero(~hard & ~sil)
    island = np.cumsum(hard)[part]
    new = np.ones(len(part), bool)
    new[1:] = (row[part][1:] != row[part][:-1]) | (island[1:] != island[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(part)) - 1
    if not len(part):
        return {k: np.zeros(0, np.int64) for k in ("row", "s", "e", "b", "a")} | {"last": np.zeros(0, bool)}
    last = run[part] == final[row[part]]
    return {
        "row": row[part][at], "s": np.minimum.reduceat(start[part], at), "e": np.maximum.reduceat(end[part], at), "b": before[part][at], "a": total[run[part]][ends],
        "last": np.logical_or.reduceat(last, at),
    }


def _swept(batch: pa.RecordBatch, key: list[str], split_us: int, pad_us: int, min_words: int) -> pa.RecordBatch:
    phones, words = _Tier(batch.column("phones")), _Tier(batch.column("words"))
    x = _spans(phones, split_us)
    row, s, e, a = (x[k] for k in ("row", "s", "e", "a"))
    dur = batch.column("dur_us")
    known, dur = dur.is_valid().to_numpy(zero_copy_only=False), dur.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    a = np.where(x["last"] & known[row], np.maximum(a, dur[row] - e), a)

    # what was said: a word itself, or those hidden in a tag where a phone of speech lies under it
    marker, hidden = words.flags(is_marker), words.texts(hidden_words)
    ask = np.flatnonzero(words.timed & marker & hidden.is_valid().to_numpy(zero_copy_only=False))
    real = np.flatnonzero(phones.timed & phones.flags(is_real_phone) & (phones.end >= phones.start))
    heard, _ = _meetings(words.start[ask], words.end[ask], words.row[ask], phones.start[real], phones.end[real], phones.row[real])
    spoken = words.flags(lambda _: True) & ~marker
    plain, found = spoken.copy(), np.zeros(len(spoken), bool)
    found[ask[heard]] = True
    spoken |= found
    said = pc.if_else(pa.array(plain), words.texts(lambda t: t), pc.if_else(pa.array(found), hidden, pa.scalar(None, pa.string())))

    able = np.flatnonzero(words.timed & (words.end >= words.start))
    span, item = _meetings(s, e, row, words.start[able], words.end[able], words.row[able])
    item = able[item]
    n_words = np.bincount(span[spoken[item]], minlength=len(s))
    usable = (np.bincount(span[words.flags(disqualifies)[item]], minlength=len(s)) == 0) & (n_words >= min_words)
    kept = np.flatnonzero(usable)
    order = kept[np.lexsort((kept, s[kept], row[kept]))]
    number = np.zeros(len(s), np.int64)
    number[order] = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
    start, end = np.maximum(0, s - np.minimum(x["b"], pad_us)), e + np.minimum(a, pad_us)

    whole = usable[span] & spoken[item]
    span, item = span[whole], item[whole]
    some = np.flatnonzero(phones.timed & (phones.end >= phones.start))
    over, under = _meetings(s[kept], e[kept], row[kept], phones.start[some], phones.end[some], phones.row[some], contained=True)
    over, under = kept[over], some[under]
    of, kind = np.concatenate([span, over]), np.repeat([1, 0], [len(span), len(over)])
    labels = pa.concat_arrays([said.take(pa.array(item)), phones.texts(rename_events).take(pa.array(under))])
    starts, ends = (np.concatenate([w[item], p[under]]) - start[of] for w, p in ((words.start, phones.start), (words.end, phones.end)))
    coded = labels.dictionary_encode()
    rank = np.argsort(pc.array_sort_indices(coded.dictionary).to_numpy(), kind="stable") if len(coded.dictionary) else np.zeros(0, np.int64)
    rank = np.append(rank, -1)[coded.indices.fill_null(len(rank)).to_numpy(zero_copy_only=False)]  # in order of bytes, none first
    order = np.lexsort((rank, ends, starts, kind, of))
    of, kind = of[order], kind[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])
    pos = np.arange(len(of)) - (np.maximum.accumulate(np.where(fresh, np.arange(len(of)), 0)) if len(of) else 0)
    kinds = pa.array(["phone", "word"]).take(pa.array(kind))
    columns = [pa.array(number[of].astype(np.int32)), kinds, pa.array(pos.astype(np.int32)), labels.take(pa.array(order)), pa.array(starts[order]), pa.array(ends[order])]
    columns += [pa.array(v[of].astype(np.int64)) for v in (start, end, n_words)]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[of])) for c in key), *columns], [*key, *(c.split()[0] for c in ITEMS.split(", "))])


#: What an item is, besides its track's key.
ITEMS = "segment int, kind string, pos int, label string, start_us bigint, end_us bigint, from_us bigint, to_us bigint, n_words bigint"


def item_batches(key: list[str], split_us: int, pad_us: int, min_words: int) -> Callable:
    """The items of ``tiers.whole_segments`` (key, ITEMS), with each one's segment from ``from_us`` to ``to_us`` and its ``n_words``, over Arrow batches of tracks, a row a track: key, words and phones, arrays of
    structs with label, start_us and end_us in order of pos, and dur_us, null where the recording's length isn't known. A track has to fit one row."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                yield _swept(batch.slice(first, AT_ONCE), key, split_us, pad_us, min_words)

    return run
