"""Matroska, MP4 and bitmap subtitles from files built here."""

import struct

import numpy as np
import pytest

from tideline.operators.matching import Index
from tideline.sources import folder, matroska, mp4, pgs
from tideline.sources.matroska import Frame, MediaError

TEXTS = ["the brass lantern hung over seven quiet harbours", "nobody counted the herons before winter came back", "a letter arrived folded inside another older letter"]
TRACK = {"number": 3, "uid": 33, "type": 17, "codec": "S_TEXT/UTF8", "language": "eng", "name": "main"}
VIDEO = {"number": 1, "uid": 11, "type": 1, "codec": "V_MPEG4/ISO/AVC"}
FRAMES = [Frame(1, 0, True, None, b"\x00" * 50), *(Frame(3, (400 + 12_000 * k) * 1_000_000, True, 1_500_000_000 if k else None, t.encode()) for k, t in enumerate(TEXTS))]


def fails(f, kind):
    with pytest.raises(MediaError) as e:
        f()
    assert e.value.kind == kind


def test_numbers_round_trip():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**40):
        assert matroska.varint(matroska.write_varint(n), 0) == (n, len(matroska.write_varint(n)))
    assert matroska.varint(b"\xff", 0)[0] == -1
    fails(lambda: matroska.varint(b"\x00", 0), "Malformed")
    fails(lambda: matroska.varint(b"\x40", 0), "Truncated")


def test_mux_demux_round_trip():
    data = matroska.mux([VIDEO, TRACK], FRAMES)
    file = matroska.Matroska(data)
    assert (file.doc_type, [t["number"] for t in file.tracks], file.duration_ns) == ("matroska", [1, 3], 25_900_000_000)
    assert list(file.frames()) == FRAMES and list(file.frames([3])) == FRAMES[1:]
    assert [c[0] for c in file.cues] == [0, 12_400_000_000, 24_400_000_000]
    assert file.seek(13_000_000_000, 3) == file.cues[1][2] and file.seek(5, 3) == 0
    assert list(file.frames(start=file.seek(13_000_000_000, 3)))[0] == FRAMES[2]


def test_embedded_text_and_its_faults():
    got = matroska.captions(matroska.Matroska(matroska.mux([VIDEO, TRACK], FRAMES)))
    assert [(c.start_ms, c.end_ms, made) for c, _, _, made in got] == [(400, 401, True), (12_400, 13_900, False), (24_400, 25_900, False)]
    read = lambda tracks, frames=FRAMES, n=None: (lambda: matroska.captions(matroska.Matroska(matroska.mux(tracks, frames)), n))
    fails(read([VIDEO, TRACK, TRACK | {"number": 4}]), "AmbiguousSubtitleTracks")
    fails(read([VIDEO]), "NoSubtitleTracks")
    fails(read([TRACK, TRACK]), "InvalidTrackMetadata")
    fails(read([TRACK], n=9), "TrackNotFound")
    fails(read([TRACK | {"codec": "S_TEXT/ASS"}]), "UnsupportedTrack")
    fails(read([TRACK | {"private": b"x"}]), "UnsupportedTrack")
    fails(read([TRACK], []), "NoCaptions")
    fails(read([TRACK], [Frame(3, 0, True, None, b"\xff")]), "InvalidUtf8")
    fails(read([TRACK], [Frame(3, 0, True, None, b" ")]), "Transcript")
    fails(read([TRACK], [FRAMES[1], Frame(3, 10**6, True, None, b"x")]), "InvalidTimestamp")
    laced = matroska.mux([TRACK], FRAMES[1:2]).replace(b"\x00\x00\x80the", b"\x00\x00\x82the")
    fails(lambda: matroska.captions(matroska.Matroska(laced)), "Unsupported")


def test_every_truncation_is_an_error_or_shorter():
    data = matroska.mux([TRACK], FRAMES[1:2])
    for n in range(len(data)):
        with pytest.raises(MediaError):
            list(matroska.Matroska(data[:n]).frames())
        try:
            assert len(list(matroska.Matroska(data[:n], strict=False).frames())) <= 1
        except MediaError:
            pass


def movie(samples, edit=None, wide=False, payload=None, timing=None, flags=0, before=False):
    """A file of one timed-text track; scale 1000 for media, 600 for the movie."""
    media = payload if payload is not None else b"".join(struct.pack(">H", len(t)) + t for t in samples)
    sizes = [len(t) + 2 for t in samples] if payload is None else [len(payload)]
    full = lambda kind, *body: mp4.box(kind, b"\0\0\0\0", *body)
    u4 = lambda *n: struct.pack(f">{len(n)}I", *n)
    timing = timing or [(len(sizes), 12_000)]
    total = sum(n * d for n, d in timing)
    description = mp4.box(b"tx3g", b"\0" * 6 + b"\0\1", u4(flags) + b"\0" * 26)

    def moov(at):
        stbl = mp4.box(b"stbl", full(b"stsd", u4(1), description), full(b"stts", u4(len(timing)), *(u4(*t) for t in timing)), full(b"stsc", u4(1, 1, len(sizes), 1)), full(b"stsz", u4(0, len(sizes), *sizes)), full(b"co64", u4(1), struct.pack(">Q", at)) if wide else full(b"stco", u4(1, at)))
        edts = mp4.box(b"edts", full(b"elst", u4(len(edit)), *(struct.pack(">IiI", a, b, 0x10000) for a, b in edit))) if edit else b""
        mdhd = full(b"mdhd", u4(0, 0, 1000, total), struct.pack(">HH", (5 << 10) | (14 << 5) | 7, 0))
        mdia = mp4.box(b"mdia", mdhd, full(b"hdlr", u4(0), b"sbtl", b"\0" * 12), mp4.box(b"minf", stbl))
        tkhd = mp4.box(b"tkhd", b"\0\0\0\1", u4(0, 0, 7, 0, 0), b"\0" * 60)
        return mp4.box(b"moov", full(b"mvhd", u4(0, 0, 600, 0)), mp4.box(b"trak", tkhd, edts, mdia))

    top = mp4.box(b"ftyp", b"isom")
    mdat = mp4.box(b"mdat", media)
    return top + moov(len(top) + len(moov(0)) + 8) + mdat if before else top + mdat + moov(len(top) + 8)


def test_mp4_text():
    for wide in (False, True):
        for before in (False, True):
            got = mp4.captions(mp4.Mp4(movie([t.encode() for t in TEXTS], wide=wide, before=before)))
            assert [(c.start_ms, c.end_ms, c.text) for c, *_ in got] == [(12_000 * k, 12_000 * (k + 1), t) for k, t in enumerate(TEXTS)]
    track = mp4.subtitle_tracks(mp4.Mp4(movie([b"x"], flags=0x40000000)))[0]
    assert (track["number"], track["language"], track["forced"], track["text"]) == (7, "eng", True, True)
    cleared = mp4.captions(mp4.Mp4(movie([b"one", b"", "﻿two\r\n".encode("utf-16-be") + b"\0x"], timing=[(3, 1000)])))
    assert [(c.start_ms, c.text) for c, *_ in cleared] == [(0, "one"), (2000, "two\nx")]
    edited = mp4.captions(mp4.Mp4(movie([b"a", b"b", b"c"], timing=[(3, 1000)], edit=[(300, -1), (600, 1500)])))
    assert [(c.start_ms, c.end_ms, c.text) for c, *_ in edited] == [(500, 1000, "b"), (1000, 1500, "c")]
    fails(lambda: mp4.captions(mp4.Mp4(movie([b"a"], payload=b"\0\x05ab"))), "Truncated")
    fails(lambda: mp4.captions(mp4.Mp4(movie([b"a"], payload=b"\0\1a" + mp4.box(b"hlit", b"")))), "UnsupportedTrack")
    assert mp4.timed_text(b"\0\1a" + mp4.box(b"styl", b"\0\1" + b"\0" * 12) + mp4.box(b"tbox", b"\0" * 8)) == "a"
    whole = movie([b"abc"])
    for n in range(len(whole)):
        with pytest.raises((MediaError, struct.error)):
            mp4.captions(mp4.Mp4(whole[:n]))


def test_lenient_sample_table():
    u4 = lambda *n: struct.pack(f">{len(n)}I", *n)
    full = lambda kind, *body: mp4.box(kind, b"\0\0\0\0", *body)
    stbl = full(b"stts", u4(2, 2, 10, 1, 5)) + full(b"stsc", u4(2, 1, 2, 1, 2, 1, 1)) + full(b"stsz", u4(0, 3, 7, 8, 9)) + full(b"stco", u4(3, 100, 200, 300)) + full(b"ctts", u4(1, 2), struct.pack(">i", -15)) + full(b"stss", u4(2, 1, 3))
    got = mp4.dense_track(memoryview(stbl))
    assert [(s["offset"], s["dts"], s["pts"], s["sync"]) for s in got] == [(100, 0, 0, True), (107, 10, 0, False), (200, 20, 20, True)]
    assert mp4.grid(bytes([0, 0, 1, 2]) + struct.pack(">HH", 640, 480)) == (2, 3, 640, 480)


def encode_lines(pixels):
    """One run for each pixel row segment; long runs and zeros included."""
    out = b""
    for line in pixels:
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            n, c = int(b - a), int(line[a])
            if c and n == 1:
                out += bytes([c])
            else:
                head = [n] if n < 64 else [0x40 | n >> 8, n & 255]
                out += bytes([0, head[0] | (0x80 if c else 0), *head[1:], *([c] if c else [])])
        out += b"\0\0"
    return out


def display_set(pixels, state=pgs.EPOCH, number=1, x=5, y=6, entries=((1, 235, 128, 128, 255), (2, 81, 240, 90, 128), (0, 16, 128, 128, 0)), objects=1):
    height, width = pixels.shape
    code = encode_lines(pixels)
    composition = struct.pack(">HHBHBBBB", 1920, 1080, 0x10, number, state, 0, 0, objects) + struct.pack(">HBBHH", 0, 0, 0, x, y) * objects
    window = b"\1" + struct.pack(">BHHHH", 0, 0, 0, 1920, 1080)
    obj = struct.pack(">HBB", 0, 0, 0xC0) + (len(code) + 4).to_bytes(3, "big") + struct.pack(">HH", width, height) + code
    parts = [(pgs.COMPOSITION, composition), (pgs.WINDOWS, window), (pgs.PALETTE, b"\0\0" + b"".join(map(bytes, entries))), (pgs.OBJECT, obj), (pgs.END, b"")]
    return b"".join(pgs.segment(k, b) for k, b in (parts if objects else [parts[0], parts[1], parts[-1]]))


def test_run_lengths_and_colours():
    rng = np.random.default_rng(1)
    for width in (3, 64, 300):
        pixels = np.repeat(rng.integers(0, 3, (4, width // 3 + 1)), 3, axis=1)[:, :width].astype(np.uint8)
        assert (pgs.run_lengths(encode_lines(pixels), width, 4) == pixels).all()
    fails(lambda: pgs.run_lengths(b"\1\1\0\0", 3, 1), "Malformed")
    assert pgs.colors(np.array([[235, 128, 128, 255], [16, 128, 128, 7]])).tolist() == [[255, 255, 255, 255], [0, 0, 0, 7]]
    assert pgs.over(np.zeros(4, np.uint8), np.array([9, 8, 7, 255], np.uint8)).tolist() == [9, 8, 7, 255]
    assert pgs.over(np.array([100, 0, 0, 255], np.uint8), np.array([0, 100, 0, 0], np.uint8)).tolist() == [100, 0, 0, 255]


def test_displays_and_intervals(spark):
    block = np.ones((4, 6), np.uint8)
    other = np.full((4, 6), 2, np.uint8)
    sets = [(0, display_set(block)), (10**9, display_set(block, number=2)), (2 * 10**9, display_set(other, pgs.ACQUISITION, 3)), (3 * 10**9, display_set(block, number=4, objects=0))]
    rows = [("f", 1, k, ts, bytearray(p)) for k, (ts, p) in enumerate(sets)] + [("bad", 1, 0, 0, bytearray(sets[0][1][:-3])), ("late", 1, 0, 5, bytearray(sets[0][1])), ("late", 1, 1, 4, bytearray(sets[1][1]))]
    shown = pgs.displays(spark.createDataFrame(rows, "doc string, track long, seq long, ts_ns long, data binary")).persist()
    got = {(r.doc, r.seq): r for r in shown.collect()}
    assert [got["f", k].unchanged for k in range(4)] == [False, True, False, False]
    assert (got["f", 0].x, got["f", 0].y, got["f", 0].w, got["f", 0].h, got["f", 0].rgba[:4]) == (5, 6, 6, 4, b"\xff\xff\xff\xff") and got["f", 3].rgba is None
    assert (got["bad", None].error, got["late", None].error) == ("IncompleteDisplaySet", "InvalidTimestamp")
    cues = pgs.recognised(shown, lambda rgba, w, h: "white" if rgba[1] == 255 else "other").orderBy("start_ms").collect()
    assert [(c.start_ms, c.end_ms, c.text, c.synthetic) for c in cues] == [(0, 2000, "white", False), (2000, 3000, "other", False)]
    seen = []
    assert not pgs.walk(iter(sets), lambda d: seen.append(d) or len(seen) < 2) and len(seen) == 2
    for n in range(1, len(sets[0][1])):
        decoder = pgs.Decoder()
        with pytest.raises(MediaError):
            decoder.push(0, sets[0][1][:n])
            decoder.finish()


def test_files_to_match(spark, tmp_path):
    (tmp_path / "a.mkv").write_bytes(matroska.mux([VIDEO, TRACK], FRAMES))
    (tmp_path / "b.mp4").write_bytes(movie([t.encode() for t in TEXTS]))
    (tmp_path / "c.m4v").write_bytes(b"\0\0\0\x08nope")
    (tmp_path / "notes.txt").write_text("x")
    files = folder.media_files(spark, str(tmp_path)).withColumnRenamed("path", "p").selectExpr("substring_index(p, '/', -1) as path", "content")
    assert {r.path: r.container for r in folder.sniff(files).collect()} == {"a.mkv": "mkv", "b.mp4": "mp4", "c.m4v": "mp4"}
    tracks = matroska.probe(files)
    assert [(r.doc, r.number) for r in matroska.eligible(tracks.filter("error is null")).collect()] == [("a.mkv", 3), ("b.mp4", 7)]
    assert tracks.filter("error is not null").first().error == "Malformed"
    assert matroska.packets(files.filter("path = 'a.mkv'"), tracks=[1]).count() == 1
    cues = matroska.extract(files).filter("error is null").select("doc", "cue", "start_ms", "text")
    references = spark.createDataFrame([("r", k, 60_000 + 12_000 * k, t) for k, t in enumerate(TEXTS)], "doc string, cue int, start_ms long, text string")
    got = {r.doc: r for r in Index.build(references).match(cues).collect()}
    assert {d: (r.outcome, r.best.offset_ms) for d, r in got.items()} == {"a.mkv": ("Identified", 59_600), "b.mp4": ("Identified", 60_000)}
    with pytest.raises(ValueError):
        folder.media_files(spark, str(tmp_path), most=1)
