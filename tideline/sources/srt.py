"""SubRip text: strict reading with error positions, checked cues, canonical writing.

Strict files are read as blocks of lines between blank lines; every block is an index, a
timing row and text. Each file is a row of binaryFile or of any table of bytes, and is
read as a whole or not at all: its error is a row of its own, never a lost task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import stamp
from ..limits import LIMITS

CUE = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string())])
TERMINATOR = re.compile(r"\r\n|\r|\n")
CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_CLOCK = r"([0-9]{2}):([0-5][0-9]):([0-5][0-9])[,.]([0-9]{3})"
_PLACE = r"(?:\s+X1:([0-9]{1,10})\s+X2:([0-9]{1,10})\s+Y1:([0-9]{1,10})\s+Y2:([0-9]{1,10}))?"
TIMING = re.compile(rf"\s*{_CLOCK}\s*-->\s*{_CLOCK}{_PLACE}\s*")


@dataclass(frozen=True)
class Cue:
    start_ms: int
    end_ms: int
    text: str


class SrtError(ValueError):
    """line: physical line from 1, or number of the cue for checked cues."""

    def __init__(self, line: int, kind: str):
        super().__init__(f"line {line}: {kind}")
        self.line, self.kind = line, kind


def decode(content: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8, or UTF-16 where a byte-order mark says so; nothing is guessed."""
    if len(content) > LIMITS.text_bytes:
        raise SrtError(1, "LimitExceeded")
    marks = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
    name = marks.get(content[:2])
    try:
        text = content[2:].decode(name) if name else content.decode("utf-8")
    except UnicodeDecodeError:
        raise SrtError(1, "InvalidText") from None
    if name:
        text = "﻿" + text
    if len(text.encode()) > LIMITS.text_bytes:
        raise SrtError(1, "LimitExceeded")
    return text, name or "utf-8"


def physical_lines(text: str) -> list[str]:
    """Lines ended by LF, CRLF or CR; a final terminator adds none."""
    lines = TERMINATOR.split(text)
    return lines[:-1] if lines[-1] == "" else lines


def timing(line: str) -> tuple[int, int] | None:
    m = TIMING.fullmatch(line)
    if m is None:
        return None
    h1, m1, s1, f1, h2, m2, s2, f2, *corners = m.groups()
    if corners[0] is not None:
        x1, x2, y1, y2 = map(int, corners)
        if x1 > x2 or y1 > y2 or max(x2, y2) > 0xFFFFFFFF:
            return None
    at = lambda h, mi, s, f: ((int(h) * 60 + int(mi)) * 60 + int(s)) * 1000 + int(f)
    return at(h1, m1, s1, f1), at(h2, m2, s2, f2)


def parse(text: str) -> list[Cue]:
    """Cues of a strict SubRip text: indexes 1, 2, ..., starts that never fall, no empty cue."""
    if len(text.encode()) > LIMITS.text_bytes:
        raise SrtError(1, "LimitExceeded")
    lines = physical_lines(text.removeprefix("﻿"))
    for n, line in enumerate(lines, 1):
        if CONTROL.search(line):
            raise SrtError(n, "InvalidText")
    cues: list[Cue] = []
    for blank, block in groupby(enumerate(lines, 1), key=lambda x: not x[1].strip()):
        if blank:
            continue
        block = list(block)
        first, index = block[0][0], block[0][1].strip()
        if len(cues) == LIMITS.cues:
            raise SrtError(first, "LimitExceeded")
        if not re.fullmatch("[0-9]{1,18}", index) or int(index) != len(cues) + 1:
            raise SrtError(first, "InvalidIndex")
        when = timing(block[1][1]) if len(block) > 1 else None
        if when is None:
            raise SrtError(first + 1, "InvalidTimestamp")
        if when[1] <= when[0] or (cues and cues[-1].start_ms > when[0]):
            raise SrtError(first + 1, "InvalidTiming")
        size = -1
        for n, line in block[2:]:
            if timing(line):
                raise SrtError(n, "MissingSeparator")
            size += 1 + len(line.encode())
            if size > LIMITS.cue_bytes:
                raise SrtError(n, "LimitExceeded")
        if len(block) == 2:
            raise SrtError(first + 2, "MissingText")
        cues.append(Cue(*when, "\n".join(line for _, line in block[2:])))
    if not cues:
        raise SrtError(1, "Empty")
    return cues


def parse_bytes(content: bytes) -> list[Cue]:
    return parse(decode(content)[0])


def checked(cues: Sequence[Cue]) -> list[Cue]:
    """Cues from elsewhere under the same bounds; the first fault is raised with the cue's number."""
    if not cues:
        raise SrtError(1, "Empty")
    if len(cues) > LIMITS.cues:
        raise SrtError(1, "LimitExceeded")
    total, before = 0, 0
    for n, cue in enumerate(cues, 1):
        if not before <= cue.start_ms < cue.end_ms <= LIMITS.max_ms:
            raise SrtError(n, "InvalidTiming")
        if CONTROL.search(cue.text.replace("\r", "\x00")):
            raise SrtError(n, "InvalidText")
        if not cue.text.strip():
            raise SrtError(n, "MissingText")
        total, before = total + len(cue.text.encode()), cue.start_ms
        if len(cue.text.encode()) > LIMITS.cue_bytes or total > LIMITS.text_bytes:
            raise SrtError(n, "LimitExceeded")
    return list(cues)


def write(cues: Sequence[Cue]) -> str:
    clock = lambda ms: f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02},{ms % 1000:03}"
    return "\n".join(f"{n}\n{clock(c.start_ms)} --> {clock(c.end_ms)}\n{c.text}\n" for n, c in enumerate(cues, 1))


def read_srt(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(doc, cue, start_ms, end_ms, text, error, line): the cues of each file, or one row with its error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "cue", "start_ms", "end_ms", "text", "error", "line"]
        for batch in batches:
            for k in range(len(batch)):
                doc, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    cues, fault = parse_bytes(content or b""), None
                except SrtError as error:
                    cues, fault = [], error
                made = [(doc, n, c.start_ms, c.end_ms, c.text, None, None) for n, c in enumerate(cues)] if fault is None else [(doc, None, None, None, None, fault.kind, fault.line)]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

    kinds = "doc string, cue int, start_ms long, end_ms long, text string, error string, line int"
    return files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(rows, kinds)


def check_cues(cues: DataFrame) -> DataFrame:
    """(doc, error, cue): each document's first fault among checked cues, null where there is none.

    The same rules as checked(), as window expressions, for cues that are rows already.
    """
    w = Window.partitionBy("doc").orderBy("cue")
    total = F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fault = (
        F.when((F.col("end_ms") <= F.col("start_ms")) | (F.col("end_ms") > LIMITS.max_ms) | (F.lag("start_ms").over(w) > F.col("start_ms")), "InvalidTiming")
        .when(F.col("text").rlike(r"[\p{Cc}&&[^\n\t]]"), "InvalidText")
        .when(F.regexp_replace("text", r"\p{IsWhite_Space}+", "") == "", "MissingText")
        .when((F.octet_length("text") > LIMITS.cue_bytes) | (total > LIMITS.text_bytes), "LimitExceeded")
        .when(F.row_number().over(w) > LIMITS.cues, "LimitExceeded")
    )
    found = cues.select("doc", F.row_number().over(w).alias("number"), fault.alias("fault"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("number", "fault")))
    return found.groupBy("doc").agg(first.alias("f")).select("doc", F.col("f.fault").alias("error"), F.col("f.number").alias("cue"))


def render(cues: DataFrame) -> DataFrame:
    """(doc, srt): the canonical text of each document's cues, renumbered in order."""
    w = Window.partitionBy("doc").orderBy("start_ms", "cue")
    entry = F.concat(F.col("n").cast("string"), F.lit("\n"), stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    per = cues.withColumn("n", F.row_number().over(w)).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))).alias("all"))
    return per.select("doc", F.array_join("all.e", "\n").alias("srt"))
