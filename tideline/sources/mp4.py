"""MP4 files: boxes, sample tables, edit lists, timed text and item tables of still images."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from ..limits import LIMITS
from .matroska import MediaError, choose
from .srt import Cue, SrtError, checked

TEXT_HANDLERS = (b"text", b"sbtl", b"subt", b"clcp")
#: Fixed values.
MOST_BOXES, MOST_SAMPLES, SAMPLE_BYTES = 100_000, 1_000_000, 64 * 1024


@dataclass(frozen=True)
class Box:
    kind: bytes
    data: memoryview
    start: int


def boxes(data: memoryview, base: int = 0) -> Iterator[Box]:
    """Boxes of a range, each whole; a size of 1 is followed by 64 bits, 0 means the rest."""
    at, n = 0, 0
    while at < len(data):
        n += 1
        if n > MOST_BOXES:
            raise MediaError("LimitExceeded", "boxes")
        if at + 8 > len(data):
            raise MediaError("Truncated", "box")
        size, kind, head = *struct.unpack_from(">I4s", data, at), 8
        if size == 1:
            if at + 16 > len(data):
                raise MediaError("Truncated", "box")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = len(data) - at if size == 0 else size
        if size < head or at + size > len(data):
            raise MediaError("Truncated", kind.decode("latin-1"))
        yield Box(kind, data[at + head : at + size], base + at + head)
        at += size


def inside(data: memoryview, *path: bytes) -> memoryview | None:
    """Content of the only box at a path; None without it, an error with two."""
    for kind in path:
        found = [b.data for b in boxes(data) if b.kind == kind]
        if len(found) > 1:
            raise MediaError("Malformed", f"two {kind.decode()}")
        if not found:
            return None
        data = found[0]
    return data


def _need(data: memoryview | None, what: str) -> memoryview:
    if data is None:
        raise MediaError("Malformed", f"no {what}")
    return data


def _array(data: memoryview, at: int, count: int, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    if at + count * dtype.itemsize != len(data):
        raise MediaError("Malformed", "table length")
    return np.frombuffer(data, dtype, count, at)


def _clock(data: memoryview) -> tuple[int, int]:
    """(time scale, duration) of a movie or media header."""
    wide = data[0] == 1
    scale, duration = struct.unpack_from(">IQ" if wide else ">II", data, 20 if wide else 12)
    if not scale:
        raise MediaError("Malformed", "time scale")
    return scale, duration


@dataclass(frozen=True)
class Samples:
    """Offset, size, decode time and duration of each sample."""

    offset: np.ndarray
    size: np.ndarray
    dts: np.ndarray
    duration: np.ndarray


def sample_table(stbl: memoryview, duration: int | None, media: Sequence[tuple[int, int]] | None) -> Samples:
    """Expand the run-length tables. With `media` (extents of media data) every sample must lie in one, and none overlap."""
    stsz = _need(inside(stbl, b"stsz"), "stsz")
    constant, count = struct.unpack_from(">II", stsz, 4)
    if count > MOST_SAMPLES:
        raise MediaError("LimitExceeded", "samples")
    size = np.full(count, constant, np.int64) if constant else _array(stsz, 12, count, ">u4").astype(np.int64)
    stts = _need(inside(stbl, b"stts"), "stts")
    runs = _array(stts, 8, 2 * struct.unpack_from(">I", stts, 4)[0], ">u4").astype(np.int64).reshape(-1, 2)
    if runs[:, 0].sum() != count or (runs[:, 0] == 0).any():
        raise MediaError("Malformed", "timing count")
    length = np.repeat(runs[:, 1], runs[:, 0])
    dts = np.cumsum(length) - length
    if duration is not None and length.sum() != duration:
        raise MediaError("Malformed", "media duration")
    narrow, wide = inside(stbl, b"stco"), inside(stbl, b"co64")
    if (narrow is None) == (wide is None):
        raise MediaError("Malformed", "chunk offsets")
    table = narrow if wide is None else wide
    chunks = _array(table, 8, struct.unpack_from(">I", table, 4)[0], ">u4" if wide is None else ">u8").astype(np.int64)
    stsc = _need(inside(stbl, b"stsc"), "stsc")
    mapping = _array(stsc, 8, 3 * struct.unpack_from(">I", stsc, 4)[0], ">u4").astype(np.int64).reshape(-1, 3)
    first = mapping[:, 0]
    if count and (not len(mapping) or first[0] != 1 or (np.diff(first) <= 0).any() or (mapping[:, 1] == 0).any()):
        raise MediaError("Malformed", "chunk mapping")
    per = mapping[np.searchsorted(first, np.arange(1, len(chunks) + 1), side="right") - 1, 1] if len(mapping) else np.zeros(0, np.int64)
    chunk = np.repeat(np.arange(len(chunks)), per)
    if len(chunk) < count or (media is not None and len(chunk) != count):
        raise MediaError("Malformed", "sample mapping")
    chunk = chunk[:count]
    before = np.cumsum(size) - size
    start = np.searchsorted(chunk, chunk)
    offset = chunks[chunk] + before - before[start]
    if media is not None:
        starts = [a for a, _ in media]
        for a, n in zip(offset.tolist(), size.tolist(), strict=True):
            k = bisect_right(starts, a) - 1
            if k < 0 or a + n > media[k][1]:
                raise MediaError("Malformed", "sample outside media data")
        order = np.argsort(offset, kind="stable")
        if (offset[order][1:] < (offset + size)[order][:-1]).any():
            raise MediaError("Malformed", "samples overlap")
    return Samples(offset, size, dts, length)


def dense_track(stbl: memoryview) -> list[dict]:
    """The lenient table: dts, pts (never negative), sync and place of every sample."""
    s = sample_table(stbl, None, None)
    n = len(s.size)
    ctts, stss = inside(stbl, b"ctts"), inside(stbl, b"stss")
    shift = np.zeros(n, np.int64)
    if ctts is not None:
        runs = _array(ctts, 8, 2 * struct.unpack_from(">I", ctts, 4)[0], ">u4").reshape(-1, 2)
        values = np.repeat(runs[:, 1].astype(np.uint32).view(np.int32).astype(np.int64), runs[:, 0].astype(np.int64))[:n]
        shift[: len(values)] = values
    sync = np.full(n, stss is None)
    if stss is not None:
        listed = _array(stss, 8, struct.unpack_from(">I", stss, 4)[0], ">u4").astype(np.int64)
        if len(listed) and (listed.min() < 1 or listed.max() > n):
            raise MediaError("Malformed", "sync sample")
        sync[listed - 1] = True
    pts = np.maximum(s.dts + shift, 0)
    return [dict(zip(("offset", "size", "dts", "duration", "pts", "sync"), row, strict=True)) for row in zip(s.offset.tolist(), s.size.tolist(), s.dts.tolist(), s.duration.tolist(), pts.tolist(), sync.tolist(), strict=True)]


class Mp4:
    """Tracks of a file, from its movie box; media data is located, not read."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        top = list(boxes(self.data))
        self.media = sorted((b.start, b.start + len(b.data)) for b in top if b.kind == b"mdat")
        moov = _need(next((b.data for b in top if b.kind == b"moov"), None), "moov")
        self.scale, _ = _clock(_need(inside(moov, b"mvhd"), "mvhd"))
        self.fragmented = inside(moov, b"mvex") is not None
        self.tracks = [self._track(b.data) for b in boxes(moov) if b.kind == b"trak"]
        ids = [t["id"] for t in self.tracks]
        if len(set(ids)) != len(ids) or 0 in ids:
            raise MediaError("InvalidTrackMetadata")

    def _track(self, trak: memoryview) -> dict:
        tkhd = _need(inside(trak, b"tkhd"), "tkhd")
        mdia = _need(inside(trak, b"mdia"), "mdia")
        mdhd = _need(inside(mdia, b"mdhd"), "mdhd")
        scale, duration = _clock(mdhd)
        packed = struct.unpack_from(">H", mdhd, 32 if mdhd[0] == 1 else 20)[0]
        stbl = _need(inside(mdia, b"minf", b"stbl"), "stbl")
        stsd = _need(inside(stbl, b"stsd"), "stsd")
        return {
            "id": struct.unpack_from(">I", tkhd, 20 if tkhd[0] == 1 else 12)[0], "enabled": bool(tkhd[3] & 1), "handler": bytes(_need(inside(mdia, b"hdlr"), "hdlr")[8:12]), "scale": scale,
            "duration": duration, "language": "".join(chr((packed >> s & 31) + 0x60) for s in (10, 5, 0)), "stbl": stbl, "descriptions": list(boxes(stsd[8:])), "edit": self._edit(inside(trak, b"edts", b"elst")),
            "shifted": inside(stbl, b"ctts") is not None,
        }

    def _edit(self, elst: memoryview | None) -> tuple[int, int, int] | None:
        """(delay, media time, length): one edit, which an empty one may precede."""
        if elst is None:
            return None
        wide, count = elst[0] == 1, struct.unpack_from(">I", elst, 4)[0]
        form = struct.Struct(">QqI" if wide else ">IiI")
        if elst[0] > 1 or not 1 <= count <= 2 or len(elst) != 8 + count * form.size:
            raise MediaError("Malformed", "edit list")
        edits = [form.unpack_from(elst, 8 + k * form.size) for k in range(count)]
        if any(rate != 0x10000 or not length for length, _, rate in edits) or edits[-1][1] < 0 or (count == 2 and edits[0][1] != -1):
            raise MediaError("Malformed", "edit list")
        return (edits[0][0] if count == 2 else 0, edits[-1][1], edits[-1][0])

    def samples(self, track: dict) -> Iterator[tuple[bytes, int, int] | None]:
        """(payload, start ns, end ns) of each sample; None where the edit leaves it out."""
        if self.fragmented or track["shifted"]:
            raise MediaError("UnsupportedTrack")
        s = sample_table(track["stbl"], track["duration"], self.media)
        for at, size, dts, length in zip(s.offset.tolist(), s.size.tolist(), s.dts.tolist(), s.duration.tolist(), strict=True):
            if size > SAMPLE_BYTES:
                raise MediaError("LimitExceeded", "sample bytes")
            payload, when = bytes(self.data[at : at + size]), self.presented(track, dts, length)
            yield (payload, *when) if when else (payload, None, None)

    def presented(self, track: dict, dts: int, length: int) -> tuple[int, int] | None:
        """Start and end in ns, cut to the edit; whole numbers all the way."""
        delay, begin, shown = track["edit"] or (0, 0, None)
        a, b = (dts - begin) * self.scale, (dts + length - begin) * self.scale
        limit = None if shown is None else shown * track["scale"]
        if track["edit"] and (b <= 0 or a >= limit):
            return None
        cut = lambda x: x if limit is None else min(max(x, 0), limit)
        return tuple((delay * track["scale"] + cut(x)) * 1_000_000_000 // (track["scale"] * self.scale) for x in (a, b))


def subtitle_tracks(file: Mp4) -> list[dict]:
    out = []
    for t in file.tracks:
        if t["handler"] not in TEXT_HANDLERS:
            continue
        if not t["descriptions"]:
            raise MediaError("InvalidTrackMetadata")
        d = t["descriptions"][0]
        text, forced = len(t["descriptions"]) == 1 and d.kind == b"tx3g" and not t["shifted"] and not file.fragmented, False
        if d.kind == b"tx3g":
            if len(d.data) < 38:
                raise MediaError("Malformed", "sample description")
            forced = bool(struct.unpack_from(">I", d.data, 8)[0] & 0xC0000000)
            text = text and not any(b.kind == b"sinf" for b in boxes(d.data[38:]))
        out.append({"number": t["id"], "uid": t["id"], "codec": d.kind.decode("latin-1"), "language": t["language"], "name": None, "enabled": t["enabled"], "default": False, "forced": forced, "default_duration_ns": None, "text": text, "track": t})
    return out


def timed_text(payload: bytes) -> str:
    """Text of a sample: UTF-8, or UTF-16 with a mark; only style and text-box modifiers may follow."""
    if len(payload) < 2 or 2 + (n := int.from_bytes(payload[:2], "big")) > len(payload):
        raise MediaError("Truncated", "text")
    raw = payload[2 : 2 + n]
    mark = {b"\xfe\xff": "utf-16-be", b"\xff\xfe": "utf-16-le"}.get(raw[:2])
    try:
        text = raw[2:].decode(mark) if mark else raw.decode().removeprefix("﻿")
    except UnicodeDecodeError:
        raise MediaError("InvalidUtf8") from None
    for b in boxes(memoryview(payload)[2 + n :]):
        styled = b.kind == b"styl" and len(b.data) >= 2 and len(b.data) == 2 + 12 * int.from_bytes(b.data[:2], "big")
        if not styled and not (b.kind == b"tbox" and len(b.data) == 8):
            raise MediaError("Malformed" if b.kind == b"styl" else "UnsupportedTrack")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def captions(file: Mp4, number: int | None = None) -> list[tuple[Cue, int, int | None, bool]]:
    """As for Matroska; empty samples clear the screen and are no cues."""
    track = choose(subtitle_tracks(file), number)
    if not track["text"]:
        raise MediaError("UnsupportedTrack")
    out = []
    for payload, start, end in file.samples(track["track"]):
        text = timed_text(payload)
        if len(text.encode()) > LIMITS.cue_bytes:
            raise MediaError("LimitExceeded", "cue bytes")
        if not text.strip() or start is None:
            continue
        a, b = start // 1_000_000, end // 1_000_000
        out.append((Cue(a, max(b, a + 1), text), start, end, b <= a))
    if not out:
        raise MediaError("NoCaptions")
    try:
        checked([c for c, *_ in out])
    except SrtError as error:
        raise MediaError("Transcript", error.kind) from None
    return out


def grid(data: bytes) -> tuple[int, int, int, int]:
    """(rows, columns, width, height) of an image grid."""
    if len(data) < 8 or data[0] != 0 or len(data) != (12 if data[1] & 1 else 8):
        raise MediaError("Malformed", "grid")
    width, height = struct.unpack_from(">II" if data[1] & 1 else ">HH", data, 4)
    return data[2] + 1, data[3] + 1, width, height


def box(kind: bytes, *body: bytes) -> bytes:
    """Bytes of a box, for fixtures."""
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data
