"""Durations of recordings from their headers: RIFF/WAVE (and RF64), FLAC and SPHERE, told apart by content.

Executors read the first bytes of each file by range, and further ones only where a chunk pushes the header's end beyond them; samples are never read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read first; chunks looked at before a file counts as broken.
HEAD_BYTES, MOST_CHUNKS = 4096, 64
FOUND = "path string, format string, rate int, channels int, frames bigint, dur_us bigint, state string"

Read = Callable[[int, int], bytes]


def wave_header(read: Read, size: int) -> tuple[int, int, int]:
    """Rate, channels, frames. A data chunk without a size, or one that goes on past the end, ends with the file."""
    at, rate, channels, block, wide = 12, 0, 0, 0, None
    for _ in range(MOST_CHUNKS):
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            wide = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            _, channels, rate, _, block = struct.unpack("<HHIIH", read(at + 8, 14))
        elif name == b"data":
            length = wide if wide is not None and length == 0xFFFFFFFF else length
            there = max(0, size - at - 8)
            return rate, channels, (there if length in (0, 0xFFFFFFFF) else min(length, there)) // block
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


def flac_header(read: Read, size: int) -> tuple[int, int, int]:
    """From the stream's first block; a stream whose encoder didn't know its length has none."""
    bits = int.from_bytes(read(18, 8), "big")
    rate, channels, frames = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
    if not frames:
        raise ValueError("no length")
    return rate, channels, frames


def sphere_header(read: Read, size: int) -> tuple[int, int, int]:
    length = int(read(8, 8))
    fields = {}
    for line in read(16, length - 16).decode("latin-1").split("\n"):
        if line.strip() == "end_head":
            break
        parts = line.split(None, 2)
        if len(parts) == 3:
            fields[parts[0]] = parts[2].strip()
    return int(fields["sample_rate"]), int(fields.get("channel_count", 1)), int(fields["sample_count"])


FORMATS = ((b"RIFF", "wave", wave_header), (b"RF64", "wave", wave_header), (b"fLaC", "flac", flac_header), (b"NIST_1A", "sphere", sphere_header))


def parse_header(read: Read, size: int) -> tuple[str | None, int | None, int | None, int | None, str]:
    """format, rate, channels, frames, state (``ok``, ``unknown`` format, ``broken``)."""
    start = read(0, min(8, size))
    for magic, name, parse in FORMATS:
        if start.startswith(magic):
            try:
                rate, channels, frames = parse(read, size)
            except (struct.error, ValueError, KeyError, ZeroDivisionError):
                return name, None, None, None, "broken"
            return (name, rate, channels, frames, "ok") if rate > 0 else (name, None, None, None, "broken")
    return None, None, None, None, "unknown"


def _ranges(source, size: int) -> Read:
    """Reads of ``source`` by place; what the first HEAD_BYTES hold is read once."""
    head = source.read_at(min(HEAD_BYTES, size), 0)

    def read(at: int, n: int) -> bytes:
        if at + n <= len(head):
            return head[at : at + n]
        return source.read_at(max(0, min(n, size - at)), at) if at < size else b""

    return read


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def media_headers(files: DataFrame) -> DataFrame:
    """``files(path)`` -> path, format, rate, channels, frames, dur_us (whole microseconds, rounded), state.

    Paths are of file systems that pyarrow knows. A file that isn't there or can't be opened is ``missing``, one of another format ``unknown``, one whose header can't be read
    ``broken``; none has a duration. Paths are spread evenly, as a header costs a round trip whatever its file's size. A null path is missing.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                found = (None, None, None, None, "missing")
                if path is not None:
                    try:
                        store, name = store_of(path)
                        with store.open_input_file(name) as source:
                            size = source.size()
                            found = parse_header(_ranges(source, size), size)
                    except (OSError, pa.ArrowInvalid):
                        pass
                form, rate, channels, frames, state = found
                dur = (frames * 2_000_000 + rate) // (2 * rate) if state == "ok" else None
                out.append((path, form, rate, channels, frames, dur, state))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                ["path", "format", "rate", "channels", "frames", "dur_us", "state"],
            )

    return files.select("path").repartition(n).mapInArrow(run, FOUND)


def media_durations(media: DataFrame, headers: DataFrame, tier: DataFrame) -> DataFrame:
    """``media(utt_id, path)`` -> utt_id, path, dur_us, origin: the header's duration, else the end of the last interval of ``tier``, else 0 (``header``, ``tier``, ``none``)."""
    last = tier.groupBy("utt_id").agg(F.max("end_us").alias("_last"))
    t = media.join(headers.select("path", F.col("dur_us").alias("_header")), "path", "left").join(last, "utt_id", "left")
    origin = F.when(F.col("_header").isNotNull(), "header").when(F.col("_last").isNotNull(), "tier").otherwise("none")
    return t.select("utt_id", "path", F.coalesce("_header", "_last", F.lit(0)).cast("bigint").alias("dur_us"), origin.alias("origin"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows(name, data)`` as files below ``folder``, each task its own, and return their paths. Null data makes an empty file."""

    def run(batches):
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, data in zip(names, batch.column("data"), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string())], ["path"])

    return rows.select("name", "data").mapInArrow(run, "path string")


def write_media(recordings: DataFrame, folder: str) -> DataFrame:
    """Write ``recordings(name, rate, samples)`` (samples array<smallint>, mono; the name's extension says the format) below ``folder`` and return their paths.

    WAVE and SPHERE hold the samples; FLAC, for which there is no encoder here, its stream's header only. A name without one of these extensions gets bytes of no format.
    """

    def run(batches):
        for batch in batches:
            made = []
            for name, rate, x in zip(batch.column("name").to_pylist(), batch.column("rate").to_pylist(), batch.column("samples"), strict=True):
                values = x.values.to_numpy().astype("<i2") if x.is_valid else b""
                made.append(encode(name, rate, len(values), bytes(values)))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(made, pa.binary())], ["name", "data"])

    return write_files(recordings.select("name", "rate", "samples").mapInArrow(run, "name string, data binary"), folder)


def encode(name: str, rate: int, frames: int, data: bytes) -> bytes:
    kind = name.rpartition(".")[2].lower()
    if kind == "wav":
        note = b"LIST" + struct.pack("<I", 4) + b"INFO"
        form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
        body = b"WAVE" + form + note + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if kind == "flac":
        sizes = struct.pack(">HH", 4096, 4096) + bytes(6)
        return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + sizes + (rate << 44 | 15 << 36 | frames).to_bytes(8, "big") + bytes(16)
    if kind == "sph":
        head = f"NIST_1A\n   1024\nsample_count -i {frames}\nsample_rate -i {rate}\nchannel_count -i 1\nsample_n_bytes -i 2\nend_head\n"
        return head.encode().ljust(1024) + data
    return b"not a recording" + data
