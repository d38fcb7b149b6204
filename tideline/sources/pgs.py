"""Bitmap subtitles: segments to displays, and displays to intervals."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matroska import MediaError

PALETTE, OBJECT, COMPOSITION, WINDOWS, END = 0x14, 0x15, 0x16, 0x17, 0x80
NORMAL, ACQUISITION, EPOCH = 0x00, 0x40, 0x80


@dataclass(frozen=True)
class Budget:
    """Work of one stream; nothing resets it."""

    packets: int = 100_000
    bytes: int = 256 << 20
    pixels: int = 4096 * 2304
    rendered: int = 2 << 30
    displays: int = 100_000


def run_lengths(data: bytes, width: int, height: int) -> np.ndarray:
    """Palette indexes of an object; every line is as wide as the object and is closed."""
    out = np.zeros((height, width), np.uint8)
    at = x = y = 0
    while at < len(data):
        first = data[at]
        at += 1
        if first:
            n, color = 1, first
        else:
            if at >= len(data):
                raise MediaError("Malformed", "run")
            flags = data[at]
            at += 1
            if not flags:
                if x != width or y >= height:
                    raise MediaError("Malformed", "line length")
                x, y = 0, y + 1
                continue
            n = flags & 0x3F
            if flags & 0x40:
                n = n << 8 | data[at] if at < len(data) else -1
                at += 1
            color = 0
            if flags & 0x80:
                if at >= len(data):
                    raise MediaError("Malformed", "run")
                color = data[at]
                at += 1
        if n < 1 or y >= height or x + n > width:
            raise MediaError("Malformed", "run")
        out[y, x : x + n] = color
        x += n
    if x or y != height:
        raise MediaError("Malformed", "line count")
    return out


def colors(entries: np.ndarray) -> np.ndarray:
    """RGBA of rows (Y, Cr, Cb, alpha): studio-range BT.709 in eighths of a byte, rounded and clamped."""
    y, cr, cb, alpha = entries.astype(np.int32).T
    y, cr, cb = 298 * (y - 16), cr - 128, cb - 128
    rgb = np.stack([y + 459 * cr, y - 137 * cr - 55 * cb, y + 541 * cb], axis=1)
    return np.column_stack([np.clip(rgb + 128 >> 8, 0, 255), alpha]).astype(np.uint8)


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Source over, for arrays of RGBA."""
    b, a = below.astype(np.int64), above.astype(np.int64)
    sa, da = a[..., 3:], b[..., 3:]
    alpha = sa * 255 + da * (255 - sa)
    safe = np.maximum(alpha, 1)
    rgb = (a[..., :3] * sa * 255 + b[..., :3] * da * (255 - sa) + alpha // 2) // safe
    return np.where(alpha > 0, np.concatenate([rgb, (alpha + 127) // 255], axis=-1), 0).astype(np.uint8)


@dataclass
class Display:
    ts_ns: int
    canvas: tuple[int, int]
    number: int
    state: int
    objects: list[tuple]
    rect: tuple[int, int, int, int] | None
    rgba: bytes | None
    unchanged: bool


@dataclass
class Decoder:
    """Packets of one track in time order; after an error it takes no more."""

    budget: Budget = field(default_factory=Budget)
    objects: dict = field(default_factory=dict)
    partial: dict = field(default_factory=dict)
    palettes: dict = field(default_factory=dict)
    windows: dict = field(default_factory=dict)
    pending: tuple | None = None
    last: Display | None = None
    time: int = -1
    used: dict = field(default_factory=lambda: dict.fromkeys(("packets", "bytes", "rendered", "displays"), 0))
    failed: bool = False

    def _spend(self, what: str, n: int) -> None:
        self.used[what] += n
        if self.used[what] > getattr(self.budget, what):
            raise MediaError("LimitExceeded", what)

    def push(self, ts_ns: int, packet: bytes) -> list[Display]:
        if self.failed:
            raise MediaError("Poisoned")
        self.failed = True
        if ts_ns < self.time:
            raise MediaError("InvalidTimestamp")
        self.time = ts_ns
        self._spend("packets", 1)
        self._spend("bytes", len(packet))
        if not packet:
            raise MediaError("Malformed", "empty packet")
        out, at = [], 0
        while at < len(packet):
            if at + 3 > len(packet):
                raise MediaError("Truncated", "segment")
            kind, size = struct.unpack_from(">BH", packet, at)
            body = packet[at + 3 : at + 3 + size]
            at += 3 + size
            if len(body) != size:
                raise MediaError("Truncated", "segment")
            if kind != COMPOSITION and self.pending is None:
                raise MediaError("MissingState", "segment before composition")
            try:
                if kind == COMPOSITION:
                    self._composition(ts_ns, body)
                elif kind == PALETTE:
                    self._palette(body)
                elif kind == OBJECT:
                    self._object(body)
                elif kind == WINDOWS:
                    if len(body) != 1 + 9 * body[0]:
                        raise MediaError("Malformed", "windows")
                    self.windows |= {w[0]: w[1:] for w in struct.iter_unpack(">BHHHH", body[1:])}
                elif kind == END and not body:
                    out.append(self._commit())
                else:
                    raise MediaError("Unsupported" if kind != END else "Malformed", "segment")
            except (struct.error, IndexError):
                raise MediaError("Truncated", "segment") from None
        self.failed = False
        return out

    def finish(self) -> None:
        if self.failed or self.pending is not None or self.partial:
            raise MediaError("IncompleteDisplaySet")

    def _composition(self, ts_ns: int, body: bytes) -> None:
        if self.pending is not None:
            raise MediaError("IncompleteDisplaySet")
        width, height, _, number, state, update, palette, count = struct.unpack_from(">HHBHBBBB", body)
        if not width or not height or width * height > self.budget.pixels or state not in (NORMAL, ACQUISITION, EPOCH) or update not in (0, 0x80):
            raise MediaError("Malformed", "composition")
        if state != EPOCH and self.last and self.last.canvas != (width, height):
            raise MediaError("Malformed", "canvas changed within an epoch")
        if state != NORMAL:
            self.objects, self.partial, self.palettes, self.windows = {}, {}, {}, {}
        at, objects = 11, []
        for _ in range(count):
            name, window, flags, x, y = struct.unpack_from(">HBBHH", body, at)
            at += 8
            if flags & 0x3F:
                raise MediaError("Malformed", "object flags")
            crop = None
            if flags & 0x80:
                crop = struct.unpack_from(">HHHH", body, at)
                at += 8
            objects.append((name, window, bool(flags & 0x40), x, y, crop))
        if at != len(body):
            raise MediaError("Malformed", "composition length")
        if update and not count:
            if state != NORMAL or self.last is None:
                raise MediaError("MissingState", "palette update")
            objects = list(self.last.objects)
        self.pending = (ts_ns, (width, height), number, state, palette, objects)

    def _palette(self, body: bytes) -> None:
        if (len(body) - 2) % 5:
            raise MediaError("Malformed", "palette")
        rows = np.frombuffer(body[2:], np.uint8).reshape(-1, 5)
        if len(np.unique(rows[:, 0])) != len(rows):
            raise MediaError("Malformed", "palette entry twice")
        table, known = self.palettes.setdefault(body[0], (np.zeros((256, 4), np.uint8), np.zeros(256, bool)))
        table[rows[:, 0]], known[rows[:, 0]] = colors(rows[:, 1:]), True

    def _object(self, body: bytes) -> None:
        name, _, place = struct.unpack_from(">HBB", body)
        if place & 0x80:
            if name in self.partial:
                raise MediaError("Malformed", "object begun twice")
            size = int.from_bytes(body[4:7], "big")
            width, height = struct.unpack_from(">HH", body, 7)
            if not width or not height or width * height > self.budget.pixels or size < 4:
                raise MediaError("Malformed", "object")
            self.partial[name] = (width, height, size - 4, bytearray(body[11:]))
        elif name not in self.partial:
            raise MediaError("MissingState", "object fragment")
        else:
            self.partial[name][3].extend(body[4:])
        width, height, size, data = self.partial[name]
        if len(data) > size:
            raise MediaError("Malformed", "object length")
        if place & 0x40:
            if len(data) != size:
                raise MediaError("Malformed", "object length")
            self.objects[name] = run_lengths(bytes(data), width, height)
            del self.partial[name]

    def _commit(self) -> Display:
        if self.partial:
            raise MediaError("IncompleteDisplaySet")
        self._spend("displays", 1)
        ts_ns, canvas, number, state, palette, objects = self.pending
        rect, rgba = self._render(palette, objects)
        same = self.last is not None and (self.last.canvas, self.last.rect, self.last.rgba) == (canvas, rect, rgba)
        self.last, self.pending = Display(ts_ns, canvas, number, state, objects, rect, rgba, same), None
        return self.last

    def _render(self, palette: int, objects: list[tuple]) -> tuple[tuple | None, bytes | None]:
        if not objects:
            return None, None
        if palette not in self.palettes:
            raise MediaError("MissingState", "palette")
        table, known = self.palettes[palette]
        placed = []
        for name, window, _, x, y, crop in objects:
            if name not in self.objects or window not in self.windows:
                raise MediaError("MissingState", "object or window")
            pixels, (wx, wy, ww, wh) = self.objects[name], self.windows[window]
            cx, cy, cw, ch = crop or (0, 0, pixels.shape[1], pixels.shape[0])
            if not cw or not ch or cx + cw > pixels.shape[1] or cy + ch > pixels.shape[0]:
                raise MediaError("Malformed", "crop")
            left, top, right, bottom = max(x, wx), max(y, wy), min(x + cw, wx + ww), min(y + ch, wy + wh)
            if left < right and top < bottom:
                placed.append((left, top, right, bottom, pixels[cy + top - y : cy + bottom - y, cx + left - x : cx + right - x]))
        if not placed:
            return None, None
        x0, y0 = min(p[0] for p in placed), min(p[1] for p in placed)
        x1, y1 = max(p[2] for p in placed), max(p[3] for p in placed)
        self._spend("rendered", (x1 - x0) * (y1 - y0))
        image = np.zeros((y1 - y0, x1 - x0, 4), np.uint8)
        for left, top, right, bottom, pixels in placed:
            if not known[pixels].all():
                raise MediaError("MissingState", "palette entry")
            spot = (slice(top - y0, bottom - y0), slice(left - x0, right - x0))
            image[spot] = over(image[spot], table[pixels])
        return (x0, y0, x1 - x0, y1 - y0), image.tobytes()


DISPLAYS = "doc string, track long, seq long, ts_ns long, width int, height int, x int, y int, w int, h int, rgba binary, unchanged boolean, error string"


def displays(packets: DataFrame) -> DataFrame:
    """Displays of packet rows (doc, track, seq, ts_ns, data): each track decoded in order by one task."""

    def decode(table: pa.Table) -> pa.Table:
        rows, decoder = [], Decoder()
        doc, track = table.column("doc")[0].as_py(), table.column("track")[0].as_py()
        table = table.sort_by("seq")
        try:
            for ts, data in zip(table.column("ts_ns").to_pylist(), table.column("data"), strict=True):
                for d in decoder.push(ts, data.as_py() or b""):
                    rows.append((doc, track, len(rows), d.ts_ns, *d.canvas, *(d.rect or (None,) * 4), d.rgba, d.unchanged, None))
            decoder.finish()
        except MediaError as error:
            rows = [(doc, track, *(None,) * 10, error.kind)]
        arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        fields = [c.split() for c in DISPLAYS.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        return pa.table([pa.array(list(c), arrow[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return packets.select("doc", "track", "seq", "ts_ns", "data").groupBy("doc", "track").applyInArrow(decode, DISPLAYS)


def recognised(shown: DataFrame, recognise: Callable[[bytes, int, int], str], sample: int | None = None) -> DataFrame:
    """Cues of displays by a caller's recogniser: unchanged displays vanish, the next one ends a cue, blanks are no cues.

    sample bounds the displays that are tried for each track, blank ones included.
    """
    from ..operators.ordered import closed_intervals, renumbered

    @F.pandas_udf("string")
    def read(rgba, w, h):
        return rgba.combine(w, lambda a, b: (a, b)).combine(h, lambda ab, c: recognise(ab[0], int(ab[1]), int(c)) if ab[0] is not None else None)

    kept = closed_intervals(shown.filter("error is null"), ["doc", "track"], ["seq"], "ts_ns", ["width", "height", "x", "y", "w", "h", "rgba"])
    kept = renumbered(kept, ["doc", "track"], ["seq"], "attempt")
    if sample is not None:
        kept = kept.filter(F.col("attempt") <= sample)
    texts = kept.withColumn("text", read("rgba", "w", "h")).filter("rgba is not null and trim(text) <> ''")
    start = F.floor(F.col("ts_ns") / 1_000_000).cast("long")
    end = F.floor(F.col("end_ts") / 1_000_000).cast("long")
    made = F.coalesce(end <= start, F.lit(True))
    return texts.select("doc", "track", "seq", start.alias("start_ms"), F.when(made, start + 1).otherwise(end).alias("end_ms"), "text", made.alias("synthetic"))


def segment(kind: int, body: bytes) -> bytes:
    """Bytes of a segment, for fixtures."""
    return struct.pack(">BH", kind, len(body)) + body


def walk(packets: Iterator[tuple[int, bytes]], emit: Callable[[Display], bool]) -> bool:
    """Decode until emit() returns false; true if the whole stream was seen."""
    decoder = Decoder()
    for ts, data in packets:
        for d in decoder.push(ts, data):
            if not emit(d):
                return False
    decoder.finish()
    return True
