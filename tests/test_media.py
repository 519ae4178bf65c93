"""Headers of media files, and durations with their fallbacks."""

import struct

from cadenza.sources import ingest as I
from cadenza.sources import media as D


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wave(*chunks, magic=b"RIFF"):
    return magic + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"".join(chunks)


FORM = chunk(b"fmt ", struct.pack("<HHIIHH", 0xFFFE, 2, 8000, 32000, 4, 16) + bytes(24))
FILES = {
    "plain.wav": (D.encode("x.wav", 16_000, 160, bytes(320)), "wave", 160, 10_000, "ok"),
    "far.wav": (wave(FORM, chunk(b"LIST", bytes(10_001)), chunk(b"data", bytes(4000))), "wave", 1000, 125_000, "ok"),
    "stream.wav": (wave(FORM, b"data" + struct.pack("<I", 0xFFFFFFFF) + bytes(400)), "wave", 100, 12_500, "ok"),
    "cut.wav": (wave(FORM, b"data" + struct.pack("<I", 4000) + bytes(40)), "wave", 10, 1250, "ok"),
    "big.wav": (wave(chunk(b"ds64", struct.pack("<QQQI", 0, 400, 0, 0)), FORM, b"data" + struct.pack("<I", 0xFFFFFFFF) + bytes(800), magic=b"RF64"), "wave", 100, 12_500, "ok"),
    "no_data.wav": (wave(FORM), "wave", None, None, "broken"),
    "no_form.wav": (wave(chunk(b"data", bytes(8))), "wave", None, None, "broken"),
    "a.flac": (D.encode("x.flac", 44_100, 441, b""), "flac", 441, 10_000, "ok"),
    "unknown_length.flac": (D.encode("x.flac", 44_100, 0, b""), "flac", None, None, "broken"),
    "sphere_named.wav": (D.encode("x.sph", 16_000, 4, bytes(8)), "sphere", 4, 250, "ok"),
    "odd.sph": (b"NIST_1A\n   1024\nsample_count -i x\n", "sphere", None, None, "broken"),
    "text.wav": (b"no header", None, None, None, "unknown"),
    "empty.wav": (b"", None, None, None, "unknown"),
}


def test_headers(spark, tmp_path):
    for name, (data, *_) in FILES.items():
        (tmp_path / name).write_bytes(data)
    paths = [(str(tmp_path / n),) for n in FILES] + [(str(tmp_path / "none.wav"),), (None,)]
    got = {(r["path"] or "").rpartition("/")[2]: r for r in D.media_headers(spark.createDataFrame(paths, "path string")).collect()}
    for name, (_, form, frames, dur, state) in FILES.items():
        r = got[name]
        assert (r["format"], r["frames"], r["dur_us"], r["state"]) == (form, frames, dur, state), name
    assert got["none.wav"]["state"] == got[""]["state"] == "missing" and got["far.wav"]["channels"] == 2
    assert D.media_headers(spark.createDataFrame([], "path string")).count() == 0


def test_only_what_is_needed_is_read():
    asked = []
    data = FILES["far.wav"][0]

    class Source:
        def read_at(self, n, at):
            asked.append((at, n))
            return data[at : at + n]

    assert D.parse_header(D._ranges(Source(), len(data)), len(data))[3] == 1000
    assert asked[0] == (0, D.HEAD_BYTES) and sum(n for _, n in asked[1:]) <= 16


def test_durations_fall_back(spark):
    media = spark.createDataFrame([("a", "/a.wav"), ("b", "/b.wav"), ("c", None), ("d", None)], "utt_id string, path string")
    headers = spark.createDataFrame([("/a.wav", 7), ("/b.wav", None)], "path string, dur_us bigint")
    tier = spark.createDataFrame([("a", 3), ("b", 3), ("b", 5), ("c", 9)], "utt_id string, end_us bigint")
    assert {r.utt_id: (r.dur_us, r.origin) for r in D.media_durations(media, headers, tier).collect()} == {"a": (7, "header"), "b": (5, "tier"), "c": (9, "tier"), "d": (0, "none")}


def test_commands(spark):
    cmd = spark.createDataFrame([("u4 ffmpeg -y -i '/c d.wav' -ar 16000 -af \"adelay=475|475,apad=pad_dur=0.475\" -f wav -",), ("u5 x -i",), ("u6 \"/c d.wav\" |",), ("u7 /c.wav",)], "value string")
    media = spark.createDataFrame([("/c d.wav", 10)], "path string, dur_us long")
    assert {r.key: r.dur_us for r in I.padded_durations(cmd, media).collect()} == {"u4": 950_010, "u5": None, "u6": 10, "u7": None}
