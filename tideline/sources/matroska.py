"""Matroska files: elements, tracks, cue points, frames, embedded text; and a small writer.

A file is decoded by one generator of elements. The strict walk takes only elements it knows
and fails on a truncated end; the lenient one skips what it does not know and stops there.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import LIMITS
from .srt import Cue, SrtError, checked


class MediaError(ValueError):
    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind} {detail}".strip())
        self.kind = kind


#: Element ids of the format, with their type. m: elements inside, u: number, f: float, s: text, b: bytes.
ELEMENTS = {
    0x1A45DFA3: ("EBML", "m"), 0x4286: ("EBMLVersion", "u"), 0x42F7: ("EBMLReadVersion", "u"), 0x42F2: ("EBMLMaxIDLength", "u"), 0x42F3: ("EBMLMaxSizeLength", "u"),
    0x4282: ("DocType", "s"), 0x4287: ("DocTypeVersion", "u"), 0x4285: ("DocTypeReadVersion", "u"), 0x18538067: ("Segment", "m"), 0x114D9B74: ("SeekHead", "b"),
    0x1549A966: ("Info", "m"), 0x2AD7B1: ("TimestampScale", "u"), 0x4489: ("Duration", "f"), 0x4461: ("DateUTC", "b"), 0x7BA9: ("Title", "s"), 0x4D80: ("MuxingApp", "s"),
    0x5741: ("WritingApp", "s"), 0x73A4: ("SegmentUID", "b"), 0x1654AE6B: ("Tracks", "m"), 0xAE: ("TrackEntry", "m"), 0xD7: ("TrackNumber", "u"), 0x73C5: ("TrackUID", "u"),
    0x83: ("TrackType", "u"), 0xB9: ("FlagEnabled", "u"), 0x88: ("FlagDefault", "u"), 0x55AA: ("FlagForced", "u"), 0x9C: ("FlagLacing", "u"), 0x6DE7: ("MinCache", "u"),
    0x23E383: ("DefaultDuration", "u"), 0x536E: ("Name", "s"), 0x22B59C: ("Language", "s"), 0x22B59D: ("LanguageIETF", "s"), 0x86: ("CodecID", "s"), 0x63A2: ("CodecPrivate", "b"),
    0x258688: ("CodecName", "s"), 0x56AA: ("CodecDelay", "u"), 0x56BB: ("SeekPreRoll", "u"), 0x55EE: ("MaxBlockAdditionID", "u"), 0x41E4: ("BlockAdditionMapping", "b"),
    0xE0: ("Video", "m"), 0xB0: ("PixelWidth", "u"), 0xBA: ("PixelHeight", "u"), 0x54B0: ("DisplayWidth", "u"), 0x54BA: ("DisplayHeight", "u"), 0x2383E3: ("FrameRate", "f"),
    0x9A: ("FlagInterlaced", "u"), 0xE1: ("Audio", "m"), 0xB5: ("SamplingFrequency", "f"), 0x78B5: ("OutputSamplingFrequency", "f"), 0x9F: ("Channels", "u"), 0x6264: ("BitDepth", "u"),
    0x1F43B675: ("Cluster", "m"), 0xE7: ("Timestamp", "u"), 0xA3: ("SimpleBlock", "b"), 0xA0: ("BlockGroup", "m"), 0xA1: ("Block", "b"), 0x9B: ("BlockDuration", "u"),
    0xFB: ("ReferenceBlock", "b"), 0x1C53BB6B: ("Cues", "m"), 0xBB: ("CuePoint", "m"), 0xB3: ("CueTime", "u"), 0xB7: ("CueTrackPositions", "m"), 0xF7: ("CueTrack", "u"),
    0xF1: ("CueClusterPosition", "u"), 0xEC: ("Void", "b"), 0xBF: ("CRC32", "b"),
}
IDS = {name: number for number, (name, _) in ELEMENTS.items()}
#: Codecs that the web profile of the container takes.
WEB_CODECS = ("V_VP8", "V_VP9", "V_AV1", "A_VORBIS", "A_OPUS", "D_WEBVTT/SUBTITLES", "D_WEBVTT/CAPTIONS", "D_WEBVTT/DESCRIPTIONS", "D_WEBVTT/METADATA")
KINDS = {1: "video", 2: "audio", 17: "subtitle"}
MOST_ELEMENTS, MOST_TRACKS = 1_000_000, 64


def varint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next position) of a variable-length number; all ones mean unknown and give -1."""
    if at >= len(data) or data[at] == 0:
        raise MediaError("Malformed", "variable-length number")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError("Truncated", "variable-length number")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def write_varint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


@dataclass
class Walker:
    """Elements of a range of bytes; the number visited over a file's life is bounded."""

    data: bytes
    strict: bool = True
    left: int = MOST_ELEMENTS

    def elements(self, at: int, end: int) -> Iterator[tuple[str, str, int, int]]:
        """(name, type, start, end) of the elements between two positions."""
        while at < end:
            self.left -= 1
            if self.left < 0:
                raise MediaError("LimitExceeded", "elements")
            try:
                number, body = varint(self.data, at, keep_marker=True)
                size, body = varint(self.data, body)
            except MediaError:
                if self.strict:
                    raise
                return
            stop = end if size < 0 else body + size
            name, kind = ELEMENTS.get(number, ("", "b"))
            if size < 0 and name not in ("Segment", "Cluster"):
                raise MediaError("Malformed", "unknown size")
            if size < 0 and name == "Cluster":
                stop = self._cluster_end(body, end)
            if stop > end:
                if self.strict:
                    raise MediaError("Truncated", name)
                stop = end
            if name:
                if name not in ("Void", "CRC32"):
                    yield name, kind, body, stop
            elif self.strict:
                raise MediaError("Unsupported", f"element {number:X}")
            at = stop

    def _cluster_end(self, at: int, end: int) -> int:
        """A cluster of unknown size ends where an element of the segment begins."""
        while at < end:
            number, body = varint(self.data, at, keep_marker=True)
            if ELEMENTS.get(number, ("",))[0] in ("Cluster", "Cues", "Tracks", "Info", "SeekHead"):
                return at
            size, body = varint(self.data, body)
            at = body + size
        return end

    def value(self, kind: str, at: int, end: int):
        raw = self.data[at:end]
        if kind == "u":
            if len(raw) > 8:
                raise MediaError("Malformed", "number")
            return int.from_bytes(raw, "big")
        if kind == "f":
            if len(raw) not in (0, 4, 8):
                raise MediaError("Malformed", "float")
            return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if raw else 0.0
        if kind == "s":
            try:
                return raw.split(b"\0", 1)[0].decode()
            except UnicodeDecodeError:
                raise MediaError("Malformed", "text") from None
        return raw

    def tree(self, at: int, end: int) -> dict[str, list]:
        out: dict[str, list] = {}
        for name, kind, a, b in self.elements(at, end):
            out.setdefault(name, []).append(self.tree(a, b) if kind == "m" else self.value(kind, a, b))
        return out


@dataclass(frozen=True)
class Frame:
    track: int
    ts_ns: int
    keyframe: bool
    duration_ns: int | None
    data: bytes


@dataclass
class Matroska:
    """Metadata of a file; frames() reads its packets."""

    data: bytes
    strict: bool = True
    doc_type: str = ""
    scale: int = 1_000_000
    duration_ns: int | None = None
    tracks: list[dict] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.walker = Walker(self.data, self.strict)
        parts = list(self._top())
        if not parts or parts[0][0] != "EBML":
            raise MediaError("Malformed", "no header")
        header = self.walker.tree(*parts[0][2:])
        self.doc_type = header.get("DocType", ["matroska"])[0]
        if self.doc_type not in ("matroska", "webm"):
            raise MediaError("Unsupported", "document type")
        segment = next((p for p in parts if p[0] == "Segment"), None)
        if segment is None:
            raise MediaError("Malformed", "no segment")
        self.clusters: list[tuple[int, int]] = []
        for name, _, a, b in self.walker.elements(*segment[2:]):
            if name == "Cluster":
                self.clusters.append((a, b))
            elif name == "Info":
                info = self.walker.tree(a, b)
                self.scale = info.get("TimestampScale", [1_000_000])[0]
                if not self.scale:
                    raise MediaError("Malformed", "time scale")
                if "Duration" in info:
                    self.duration_ns = round(info["Duration"][0] * self.scale)
            elif name == "Tracks":
                self.tracks = [self._track(t) for t in self.walker.tree(a, b).get("TrackEntry", [])]
            elif name == "Cues":
                for point in self.walker.tree(a, b).get("CuePoint", []):
                    for place in point.get("CueTrackPositions", []):
                        if "CueTime" in point and {"CueTrack", "CueClusterPosition"} <= place.keys():
                            self.cues.append((point["CueTime"][0] * self.scale, place["CueTrack"][0], place["CueClusterPosition"][0] + segment[2]))
                        elif self.strict:
                            raise MediaError("Malformed", "cue point")

    def _top(self):
        at = 0
        while at < len(self.data):
            for found in self.walker.elements(at, len(self.data)):
                yield found
                at = found[3]
                break
            else:
                return

    def _track(self, t: dict) -> dict:
        one = lambda name, default=None: t.get(name, [default])[0]
        kind, codec = KINDS.get(one("TrackType"), "other"), one("CodecID", "")
        prefix = {"video": "V_", "audio": "A_", "subtitle": "S_"}.get(kind)
        if self.doc_type == "webm" and codec not in WEB_CODECS:
            raise MediaError("Unsupported", f"codec {codec}")
        if self.doc_type == "matroska" and prefix and not codec.startswith(prefix):
            raise MediaError("Malformed", "codec of another kind")
        return {
            "number": one("TrackNumber", 0), "uid": one("TrackUID", 0), "kind": kind, "codec": codec, "language": one("LanguageIETF") or one("Language", "eng"), "name": one("Name"),
            "enabled": bool(one("FlagEnabled", 1)), "default": bool(one("FlagDefault", 1)), "forced": bool(one("FlagForced", 0)), "default_duration_ns": one("DefaultDuration"),
            "codec_delay_ns": one("CodecDelay", 0), "seek_pre_roll_ns": one("SeekPreRoll", 0), "private": one("CodecPrivate"), "media": bool(t.get("Video") or t.get("Audio")),
        }

    def frames(self, only: Sequence[int] | None = None, start: int = 0) -> Iterator[Frame]:
        """Frames from the cluster at or after a position; the bytes of other tracks are not read."""
        for a, b in self.clusters:
            if b <= start:
                continue
            stamp = None
            for name, _, x, y in self.walker.elements(a, b):
                if name == "Timestamp":
                    stamp = self.walker.value("u", x, y)
                elif name == "SimpleBlock":
                    yield from self._block(stamp, x, y, only, None, None)
                elif name == "BlockGroup":
                    group = {n: (p, q) for n, _, p, q in self.walker.elements(x, y)}
                    if "Block" not in group:
                        raise MediaError("Malformed", "group without a block")
                    duration = self.walker.value("u", *group["BlockDuration"]) * self.scale if "BlockDuration" in group else None
                    yield from self._block(stamp, *group["Block"], only, duration, "ReferenceBlock" not in group)

    def _block(self, stamp, at, end, only, duration, keyframe) -> Iterator[Frame]:
        if stamp is None:
            raise MediaError("Malformed", "block before its cluster's time")
        track, at = varint(self.data, at)
        if at + 3 > end:
            raise MediaError("Truncated", "block")
        if only is not None and track not in only:
            return
        delta, flags = struct.unpack_from(">hB", self.data, at)
        if flags & 0x06:
            raise MediaError("Unsupported", "lacing")
        if stamp + delta < 0:
            raise MediaError("InvalidTimestamp")
        yield Frame(track, (stamp + delta) * self.scale, bool(flags & 0x80) if keyframe is None else keyframe, duration, bytes(self.data[at + 3 : end]))

    def seek(self, ts_ns: int, track: int) -> int:
        """Position of the cluster of the last cue at or before a time; of equal times the last; 0 without one."""
        held = [(time, k, at) for k, (time, t, at) in enumerate(self.cues) if t == track and time <= ts_ns]
        return max(held)[2] if held else 0


def subtitle_tracks(file: Matroska) -> list[dict]:
    """Subtitle tracks with `text` and `pgs`: can their packets be read as text or as bitmaps?"""
    if file.doc_type != "matroska":
        raise MediaError("Container", "document type")
    if len(file.tracks) > MOST_TRACKS:
        raise MediaError("LimitExceeded", "tracks")
    numbers = [t["number"] for t in file.tracks]
    if 0 in numbers or len(set(numbers)) != len(numbers) or any(len((t[k] or "").encode()) > 1024 for t in file.tracks for k in ("codec", "name", "language")):
        raise MediaError("InvalidTrackMetadata")
    plain = lambda t: not t["codec_delay_ns"] and not t["seek_pre_roll_ns"] and not t["private"] and not t["media"]
    return [t | {"text": t["codec"] == "S_TEXT/UTF8" and plain(t), "pgs": t["codec"] == "S_HDMV/PGS" and plain(t)} for t in file.tracks if t["kind"] == "subtitle"]


def choose(tracks: list[dict], number: int | None) -> dict:
    if number is None:
        if len(tracks) != 1:
            raise MediaError("AmbiguousSubtitleTracks" if tracks else "NoSubtitleTracks")
        return tracks[0]
    found = [t for t in tracks if t["number"] == number]
    if not found:
        raise MediaError("TrackNotFound")
    return found[0]


def captions(file: Matroska, number: int | None = None) -> list[tuple[Cue, int, int | None, bool]]:
    """(cue, start in ns, declared end in ns, end made up) of the text track; all of it is sound, or nothing is returned."""
    track = choose(subtitle_tracks(file), number)
    if not track["text"]:
        raise MediaError("UnsupportedTrack")
    out, last, total = [], 0, 0
    for frame in file.frames([track["number"]]):
        total += len(frame.data)
        if len(out) == LIMITS.cues or total > LIMITS.text_bytes:
            raise MediaError("LimitExceeded", "captions")
        try:
            text = frame.data.decode().replace("\r\n", "\n")
        except UnicodeDecodeError:
            raise MediaError("InvalidUtf8") from None
        duration = frame.duration_ns if frame.duration_ns is not None else track["default_duration_ns"]
        end = None if duration is None else frame.ts_ns + duration
        start_ms = frame.ts_ns // 1_000_000
        if frame.ts_ns < last or start_ms >= LIMITS.max_ms or (end or 0) // 1_000_000 > LIMITS.max_ms:
            raise MediaError("InvalidTimestamp")
        made = end is None or end // 1_000_000 <= start_ms
        out.append((Cue(start_ms, start_ms + 1 if made else end // 1_000_000, text), frame.ts_ns, end, made))
        last = frame.ts_ns
    if not out:
        raise MediaError("NoCaptions")
    try:
        checked([c for c, *_ in out])
    except SrtError as error:
        raise MediaError("Transcript", error.kind) from None
    return out


def element(name: str, body) -> bytes:
    """Bytes of an element: numbers, floats, text, bytes, or a list of written elements."""
    kind, number = ELEMENTS[IDS[name]][1], IDS[name]
    if kind == "m":
        body = b"".join(body)
    elif kind == "u":
        body = body.to_bytes(max(1, -(-body.bit_length() // 8)), "big")
    elif kind == "f":
        body = struct.pack(">d", body)
    elif kind == "s":
        body = body.encode()
    return number.to_bytes(-(-number.bit_length() // 8), "big") + write_varint(len(body)) + body


def mux(tracks: Sequence[dict], frames: Sequence[Frame], scale: int = 1_000_000, doc_type: str = "matroska", video: int | None = None) -> bytes:
    """A whole file. A cluster ends when it has lasted a second, or before a later keyframe of the video track."""
    names = {"number": "TrackNumber", "uid": "TrackUID", "type": "TrackType", "codec": "CodecID", "language": "Language", "ietf": "LanguageIETF", "name": "Name", "enabled": "FlagEnabled", "default": "FlagDefault", "forced": "FlagForced", "default_duration_ns": "DefaultDuration", "private": "CodecPrivate", "codec_delay_ns": "CodecDelay"}
    entries = [element("TrackEntry", [element(names[k], int(v) if isinstance(v, bool) else v) for k, v in t.items()]) for t in tracks]
    header = element("EBML", [element("EBMLVersion", 1), element("EBMLReadVersion", 1), element("DocType", doc_type), element("DocTypeVersion", 4), element("DocTypeReadVersion", 2)])
    end = max((f.ts_ns + (f.duration_ns or 0) for f in frames), default=0)
    body = element("Info", [element("TimestampScale", scale), element("Duration", end / scale)]) + element("Tracks", entries)
    groups: list[list[Frame]] = []
    for f in frames:
        if not groups or f.ts_ns - groups[-1][0].ts_ns >= 1_000_000_000 or (f.track == video and f.keyframe):
            groups.append([])
        groups[-1].append(f)
    points = []
    for group in groups:
        base = min(f.ts_ns for f in group) // scale
        points.append(element("CuePoint", [element("CueTime", group[0].ts_ns // scale), element("CueTrackPositions", [element("CueTrack", group[0].track), element("CueClusterPosition", len(body))])]))
        blocks = [element("Timestamp", base)]
        for f in group:
            lead = write_varint(f.track) + struct.pack(">h", f.ts_ns // scale - base)
            if f.duration_ns is None:
                blocks.append(element("SimpleBlock", lead + bytes([0x80 * f.keyframe]) + f.data))
            else:
                blocks.append(element("BlockGroup", [element("Block", lead + b"\0" + f.data), element("BlockDuration", f.duration_ns // scale), *([] if f.keyframe else [element("ReferenceBlock", b"\xff")])]))
        body += element("Cluster", blocks)
    return header + element("Segment", [body + element("Cues", points)])


def _table(files: DataFrame, make, schema: str, id_col: str, content_col: str) -> DataFrame:
    """One generator of rows for each file; a file that cannot be read gives one row with its error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        kinds = [arrow[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for k in range(len(batch)):
                doc = batch.column(0)[k].as_py()
                try:
                    made = [(doc, *r, None) for r in make(batch.column(1)[k].as_py() or b"")]
                except MediaError as error:
                    made = [(doc, *[None] * (len(names) - 2), error.kind)]
                if made:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

    return files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(rows, schema)


def probe(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Subtitle tracks of every file, Matroska or MP4."""
    from . import mp4

    columns = ("number", "uid", "codec", "language", "name", "enabled", "default", "forced", "default_duration_ns", "text")

    def make(data: bytes):
        tracks = subtitle_tracks(Matroska(data)) if data.startswith(b"\x1aE\xdf\xa3") else mp4.subtitle_tracks(mp4.Mp4(data))
        return [tuple(t[c] for c in columns) for t in tracks]

    return _table(files, make, "doc string, number long, uid long, codec string, language string, name string, enabled boolean, is_default boolean, forced boolean, default_duration_ns long, supported boolean, error string", id_col, content_col)


def extract(files: DataFrame, number: int | None = None, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Captions of one text track of every file, Matroska or MP4."""
    from . import mp4

    def make(data: bytes):
        found = captions(Matroska(data), number) if data.startswith(b"\x1aE\xdf\xa3") else mp4.captions(mp4.Mp4(data), number)
        return [(k, c.start_ms, c.end_ms, c.text, start, end, made) for k, (c, start, end, made) in enumerate(found)]

    return _table(files, make, "doc string, cue int, start_ms long, end_ms long, text string, start_ns long, declared_end_ns long, synthetic boolean, error string", id_col, content_col)


def packets(files: DataFrame, strict: bool = True, tracks: Sequence[int] | None = None, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Frames of every Matroska file, of some tracks or of all."""

    def make(data: bytes):
        return [(k, f.track, f.ts_ns, f.keyframe, f.duration_ns, f.data) for k, f in enumerate(Matroska(data, strict).frames(tracks))]

    return _table(files, make, "doc string, seq long, track long, ts_ns long, keyframe boolean, duration_ns long, data binary, error string", id_col, content_col)


def eligible(tracks: DataFrame) -> DataFrame:
    """English, enabled and not forced tracks of a codec that can be read, by number."""
    language = F.lower(F.coalesce("language", F.lit("")))
    good = (language.isin("en", "eng") | language.startswith("en-")) & F.col("enabled") & ~F.col("forced") & F.col("codec").isin("S_TEXT/UTF8", "S_HDMV/PGS", "tx3g")
    return tracks.filter(good).orderBy("doc", "number")
