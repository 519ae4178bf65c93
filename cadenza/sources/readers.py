"""Corpus readers as data sources: ``spark.read.format(name).load(folder)`` after ``register``, a task for each group of files.

Options: ``rate`` (samples a second), ``pattern`` (of file names), ``groupBytes`` (bytes of files a task). Rows are those that the functions in ``ingest`` give for the same files.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .media import store_of

GROUP_BYTES = 32 << 20


class Files(InputPartition):
    """The files of one task, with their sizes."""

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class TierReader(DataSourceReader):
    def __init__(self, options: dict, pattern: str, parse):
        self.folder, self.parse = options["path"], parse
        self.pattern, self.group = options.get("pattern", pattern), int(options.get("groupbytes", GROUP_BYTES))

    def partitions(self) -> list[Files]:
        """Files in order of their names, in groups of about ``groupBytes``; listed, not opened."""
        store, base = store_of(self.folder)
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name.lower(), self.pattern.lower()))
        groups, held, size = [], [], 0
        for name, n in found:
            if held and size + n > self.group:
                groups.append(Files(held))
                held, size = [], 0
            held.append(name)
            size += n
        return [*groups, *([Files(held)] if held else [])] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for name in partition.names:
            with store.open_input_stream(name, compression=None) as source:
                text = source.read().decode("utf-8", "replace")
            for pos, row in enumerate(self.parse(text)):
                yield (name, *row[:1], *row[1:3], pos, *row[3:])


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def micros(value: float) -> int:
    """Rounded half away from 0, as Spark rounds."""
    return int(value + 0.5) if value >= 0 else -int(-value + 0.5)


def columns(line: str) -> list[str]:
    return re.split(r"\s+", line.strip(" "), maxsplit=2)


def sample_rows(text: str, rate: int) -> Iterator[tuple]:
    """label, start_us, end_us of lines ``start end label…`` in whole samples."""
    for line in re.split("\r?\n", text):
        parts = columns(line)
        if len(parts) == 3 and all(re.fullmatch("[+-]?[0-9]+", p) for p in parts[:2]):
            start, end = (micros(int(p) * 1_000_000 / rate) for p in parts[:2])
            yield parts[2], start, end


def cumulative_rows(text: str) -> Iterator[tuple]:
    """label, start_us, end_us, fields of lines ``end code label; …`` in seconds after the first line ``#``."""
    lines, last = re.split("\r?\n", text), 0
    head = next((i for i, x in enumerate(lines) if x.strip(" ") == "#"), len(lines))
    for line in lines[head + 1 :]:
        parts = columns(line)
        end = number(parts[0])
        if end is None:
            continue
        rest = [x.strip(" ") for x in (parts[2] if len(parts) > 2 else "").split(";")]
        end = micros(end * 1_000_000)
        yield rest[0] or (parts[1] if len(parts) > 1 else None), last, end, rest[1:]
        last = end


class SampleTiers(DataSource):
    """``start end label…`` in samples: path, label, start_us, end_us, pos."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_sample_tiers"

    def schema(self) -> str:
        return "path string, label string, start_us bigint, end_us bigint, pos int"

    def reader(self, schema) -> TierReader:
        rate = int(self.options.get("rate", 16_000))
        return TierReader(dict(self.options), "*.phn", lambda text: sample_rows(text, rate))


class CumulativeTiers(DataSource):
    """``end code label; …`` in seconds after a header: path, label, start_us, end_us, pos, fields."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_cumulative_tiers"

    def schema(self) -> str:
        return "path string, label string, start_us bigint, end_us bigint, pos int, fields array<string>"

    def reader(self, schema) -> TierReader:
        return TierReader(dict(self.options), "*.words", cumulative_rows)


READERS = (SampleTiers, CumulativeTiers)


def register(spark: SparkSession) -> list[str]:
    """Makes all readers known to the session, and returns their names. ``spark.read.format`` raises for any other."""
    for source in READERS:
        spark.dataSource.register(source)
    return [source.name() for source in READERS]
