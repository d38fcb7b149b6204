"""Still-image files: items, where they lie, how they refer to each other, and their properties."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .matroska import MediaError
from .mp4 import Box, boxes, inside


class _Reader:
    def __init__(self, data):
        self.data, self.at = bytes(data), 0

    def number(self, width: int) -> int:
        if self.at + width > len(self.data):
            raise MediaError("Truncated", "item table")
        self.at += width
        return int.from_bytes(self.data[self.at - width : self.at], "big")

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        end = len(self.data) if end < 0 else end
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out


@dataclass
class Heif:
    data: bytes
    primary: int = 0
    items: dict[int, tuple[str, str]] = field(default_factory=dict)
    places: dict[int, tuple[int, list[tuple[int, int]]]] = field(default_factory=dict)
    references: list[tuple[int, str, list[int]]] = field(default_factory=list)
    properties: list[tuple[str, object]] = field(default_factory=list)
    associations: dict[int, list[tuple[int, bool]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        view = memoryview(self.data)
        top = list(boxes(view))
        if not top or top[0].kind != b"ftyp":
            raise MediaError("Malformed", "no file type")
        meta = inside(view, b"meta")
        if meta is None:
            raise MediaError("Malformed", "no meta")
        self.media = [(b.start, b.start + len(b.data)) for b in top if b.kind == b"mdat"]
        self.idat = b""
        for b in boxes(meta[4:]):
            name = f"_{b.kind.decode('latin-1')}"
            if b.kind in (b"pitm", b"iinf", b"iloc", b"iref", b"iprp", b"idat"):
                getattr(self, name)(b)

    def _idat(self, b: Box) -> None:
        self.idat = bytes(b.data)

    def _pitm(self, b: Box) -> None:
        r = _Reader(b.data)
        self.primary = r.number(2 if r.number(4) >> 24 == 0 else 4)

    def _iinf(self, b: Box) -> None:
        skip = 6 if b.data[0] == 0 else 8
        for entry in boxes(b.data[skip:]):
            r = _Reader(entry.data)
            version = r.number(4) >> 24
            if version < 2:
                raise MediaError("Unsupported", "item info")
            number = r.number(2 if version == 2 else 4)
            r.number(2)
            kind = r.number(4).to_bytes(4, "big").decode("latin-1")
            self.items[number] = (kind, r.text())

    def _iloc(self, b: Box) -> None:
        r = _Reader(b.data)
        version = r.number(4) >> 24
        sizes = r.number(2)
        offset, length, base, index = (sizes >> s & 15 for s in (12, 8, 4, 0))
        if version > 2 or any(x not in (0, 4, 8) for x in (offset, length, base)):
            raise MediaError("Unsupported", "item locations")
        for _ in range(r.number(4 if version == 2 else 2)):
            number = r.number(4 if version == 2 else 2)
            method = r.number(2) & 15 if version else 0
            r.number(2)
            start, extents = r.number(base), []
            for _ in range(r.number(2)):
                if version:
                    r.number(index)
                extents.append((start + r.number(offset), r.number(length)))
            self.places[number] = (method, extents)

    def _iref(self, b: Box) -> None:
        wide = 4 if b.data[0] else 2
        for ref in boxes(b.data[4:]):
            r = _Reader(ref.data)
            source = r.number(wide)
            self.references.append((source, ref.kind.decode("latin-1"), [r.number(wide) for _ in range(r.number(2))]))

    def _iprp(self, b: Box) -> None:
        for p in boxes(inside(b.data, b"ipco") or memoryview(b"")):
            self.properties.append((p.kind.decode("latin-1"), self._property(p)))
        for table in (x.data for x in boxes(b.data) if x.kind == b"ipma"):
            r = _Reader(table)
            head = r.number(4)
            for _ in range(r.number(4)):
                number, found = r.number(4 if head >> 24 else 2), []
                for _ in range(r.number(1)):
                    width = 2 if head & 1 else 1
                    value = r.number(width)
                    found.append((value & (1 << 8 * width - 1) - 1, bool(value >> 8 * width - 1)))
                self.associations.setdefault(number, []).extend(found)

    @staticmethod
    def _property(p: Box):
        data = bytes(p.data)
        try:
            if p.kind == b"ispe":
                return struct.unpack(">II", data[4:12])
            if p.kind == b"pixi":
                return list(data[5 : 5 + data[4]])
            if p.kind == b"pasp":
                return struct.unpack(">II", data[:8])
            if p.kind == b"auxC":
                return data[4:].split(b"\0")[0].decode()
            if p.kind == b"irot":
                return data[0] & 3
            if p.kind == b"imir":
                return "horizontal" if data[0] & 1 else "vertical"
            if p.kind == b"colr" and data[:4] == b"nclx":
                return (*struct.unpack(">HHH", data[4:10]), bool(data[10] & 0x80))
        except (struct.error, IndexError, UnicodeDecodeError):
            raise MediaError("Malformed", "property") from None
        return data[4:] if p.kind == b"colr" else data

    def properties_of(self, item: int) -> list[tuple[str, object]]:
        """In association order; number 0 and numbers beyond the table stand for nothing."""
        return [self.properties[n - 1] for n, _ in self.associations.get(item, []) if 1 <= n <= len(self.properties)]

    def read(self, item: int) -> bytes:
        """An item's bytes: extents in the file must lie in media data, others in the inline data."""
        if item not in self.places:
            raise MediaError("Malformed", "no location")
        method, extents = self.places[item]
        if method not in (0, 1):
            raise MediaError("Unsupported", "construction method")
        held = self.media if method == 0 else [(0, len(self.idat))]
        source = self.data if method == 0 else self.idat
        out = []
        for start, length in extents:
            if not any(a <= start and start + length <= b for a, b in held):
                raise MediaError("Malformed", "extent")
            out.append(source[start : start + length])
        return b"".join(out)
