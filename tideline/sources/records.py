"""Provider records: lenient framing of damaged SubRip text, and its clean-up with a ledger.

Timing rows are found first and everything hangs on them: the line before one may be its
label, and the lines up to the next one are its caption. Labels may be missing or
fractional, clocks unpadded, separators absent; what stays ambiguous is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import LIMITS
from .srt import Cue, SrtError, decode, physical_lines, write

CONTROL = re.compile("[\x00-\x08\x0a-\x1f\x7f-\x91\x93-\x9c\x9e-\x9f]")
LABEL = re.compile(r"[0-9]{1,10}(?:\.[0-9]{1,9})?")
CLOCK = re.compile(r"([0-9]{1,6}):([0-9]{1,6}):([0-9]{1,6})[,.]([0-9]{1,3})")
PLACEMENT = re.compile(r"X1:([0-9]{1,10})\s+X2:([0-9]{1,10})\s+Y1:([0-9]{1,10})\s+Y2:([0-9]{1,10})")
CANONICAL = re.compile(r"[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} --> [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}")
NUMERIC = re.compile("[0-9.\u0092\u009d]+")
HEADERISH = re.compile("[0-9.,+\\-\u0092\u009d]+")
#: Codes that stand for a lost character.
C1 = {0x92: "�", 0x9D: "�"}


@dataclass(frozen=True)
class Record:
    cue: Cue
    label: str | None
    header_line: int
    timing_line: int
    body_end: int
    separated: bool
    normalized: bool
    blank_lines: tuple[int, ...]
    placement: tuple[int, ...] | None

    @property
    def missing_text(self) -> bool:
        return not self.cue.text and self.body_end == self.timing_line


def _clock(text: str) -> int | None:
    m = CLOCK.fullmatch(text)
    if not m:
        return None
    h, mi, s, fraction = int(m[1]), int(m[2]), int(m[3]), int(m[4].ljust(3, "0"))
    return ((h * 60 + mi) * 60 + s) * 1000 + fraction if h <= 99 and mi <= 59 and s <= 59 else None


@dataclass(frozen=True)
class _Row:
    start: int
    end: int
    normalized: bool
    placement: tuple[int, ...] | None


def _timing(line: str, number: int) -> _Row | None:
    left, arrow, right = line.partition("-->")
    if not arrow:
        return None
    left, right = left.strip(), right.strip()
    end, rest = (*right.split(None, 1), "", "")[:2]
    start_ms, end_ms = _clock(left), _clock(end)
    place = PLACEMENT.fullmatch(rest.strip())
    corners = tuple(map(int, place.groups())) if place else None
    misplaced = bool(rest) and (corners is None or corners[0] > corners[1] or corners[2] > corners[3] or max(corners) > 0xFFFFFFFF)
    if start_ms is None or end_ms is None or misplaced:
        if any(":" in side and re.match("[-+]*[0-9]", side) for side in (left, right)):
            raise SrtError(number, "InvalidTimestamp")
        return None
    if end_ms < start_ms:
        raise SrtError(number, "InvalidTiming")
    return _Row(start_ms, end_ms, CANONICAL.fullmatch(line.strip()) is None, corners)


def _label(line: str) -> Decimal | None:
    text = line.strip()
    return Decimal(text) if LABEL.fullmatch(text) and int(text.partition(".")[0]) <= 0xFFFFFFFF else None


def frame(text: str) -> list[Record]:
    """All records of a text in order, those without a caption included."""
    if len(text.encode()) > LIMITS.text_bytes:
        raise SrtError(1, "LimitExceeded")
    lines = physical_lines(text.removeprefix("﻿"))
    rows: dict[int, _Row] = {}
    for n, line in enumerate(lines):
        if CONTROL.search(line):
            raise SrtError(n + 1, "InvalidText")
        if row := _timing(line, n + 1):
            rows[n] = row
    if len(rows) > LIMITS.cues:
        raise SrtError(1, "LimitExceeded")
    blank = [not line.strip() for line in lines]
    times, out = sorted(rows), []
    previous: Decimal | None = None
    at = next((n for n, b in enumerate(blank) if not b), len(lines))
    for k, t in enumerate(times):
        after = times[k + 1] if k + 1 < len(times) else len(lines)
        label = None
        if at < t:
            label = _label(lines[at])
            if label is None or (label <= previous if previous is not None else label != 1):
                raise SrtError(at + 1, "InvalidIndex")
            if at != t - 1:
                raise SrtError(at + 2, "InvalidTimestamp")
            previous = label
        # the caption ends before the next record's label, or its timing row
        stop = after
        if after < len(lines) and after - 1 > t and _label(lines[after - 1]) is not None:
            stop = after - 1
        body = t + 1
        end = next((n for n in range(body, stop) if blank[n]), stop)
        if end == stop == after and after < len(lines) and end > body and NUMERIC.fullmatch(lines[after - 1].strip()):
            raise SrtError(after, "InvalidIndex")
        separated = at == 0 or blank[at - 1]
        blanks: tuple[int, ...] = ()
        if end < stop and end > body and _consecutive(lines, blank, label, at, separated, after):
            last = max((n for n in range(end, after - 1) if not blank[n]), default=None)
            if last is not None:
                if any(not blank[n] and ("-->" in lines[n] or HEADERISH.fullmatch(lines[n].strip())) for n in range(end, last + 1)):
                    raise SrtError(end + 1, "InvalidIndex")
                blanks = tuple(n + 1 for n in range(end, last + 1) if blank[n])
                end = last + 1
        caption = "\n".join(lines[body:end])
        if len(caption.encode()) > LIMITS.cue_bytes:
            raise SrtError(body + 1, "LimitExceeded")
        row = rows[t]
        out.append(Record(Cue(row.start, row.end, caption), None if label is None else lines[at].strip(), at + 1, t + 1, end, separated, row.normalized, blanks, row.placement))
        at = next((n for n in range(end, len(lines)) if not blank[n]), len(lines))
    if at < len(lines):
        label = _label(lines[at])
        good = label is not None and (label > previous if previous is not None else label == 1)
        raise SrtError(at + 2 if good else at + 1, "InvalidTimestamp" if good else "InvalidIndex")
    return out


def _consecutive(lines: list[str], blank: list[bool], label: Decimal | None, at: int, separated: bool, after: int) -> bool:
    """Do both neighbouring headers stand alone and count on by one, so that a gap between them is a paragraph?"""
    if label is None or after >= len(lines) or not separated or not lines[at].strip().isdigit():
        return False
    if after < 1 or not (after == 1 or blank[after - 2]):
        return False
    following = lines[after - 1].strip()
    return following.isdigit() and _label(following) == label + 1


@dataclass
class Prepared:
    """Cleaned cues and what was done to them; None where a step found nothing to do."""

    cues: list[Cue]
    ledger: dict = field(default_factory=dict)

    @property
    def text(self) -> str:
        return write(self.cues)


def digest(domain: str, numbers: list[int]) -> str:
    """SHA-256 of a domain and numbers as big-endian 32-bit words."""
    return hashlib.sha256(domain.encode() + b"\0" + b"".join(n.to_bytes(4, "big") for n in numbers)).hexdigest()


def prepare(text: str, encoding: str = "utf-8") -> Prepared:
    """Frame, then normalise lost characters, join paragraphs, omit what has no text or no length, sort by start."""
    records = frame(text)
    ledger: dict = {}

    def note(name: str, **numbers) -> None:
        ordinals = numbers.pop("ordinals")
        if ordinals:
            ledger[name] = {**numbers, "affected": len(ordinals), "sha256": digest(name, ordinals)}

    hit = [k for k, r in enumerate(records, 1) if any(chr(c) in r.cue.text for c in C1)]
    replaced = {f"U+{c:04X}": sum(r.cue.text.count(chr(c)) for r in records) for c in C1}
    note("lost-characters", ordinals=hit, codepoints={c: n for c, n in replaced.items() if n})
    note("paragraphs", ordinals=[k for k, r in enumerate(records, 1) if r.blank_lines], removed=sum(len(r.blank_lines) for r in records))
    note("boundaries", ordinals=[k for k, r in enumerate(records, 1) if not r.separated])
    note("framing", ordinals=[k for k, r in enumerate(records, 1) if r.normalized])
    note("numbering", ordinals=[k for k, r in enumerate(records, 1) if r.label != str(k)])
    note("missing-text", ordinals=[k for k, r in enumerate(records, 1) if r.missing_text])
    note("zero-duration", ordinals=[k for k, r in enumerate(records, 1) if not r.missing_text and r.cue.end_ms == r.cue.start_ms])
    note("placement", ordinals=[k for k, r in enumerate(records, 1) if r.placement])
    bare = [m.start() for m in re.finditer(r"\r(?!\n)", text)]
    if encoding != "utf-8" or bare:
        ledger["layout"] = {"encoding": encoding, "bare_cr": len(bare), "sha256": digest(f"layout {encoding}", bare)}
    cues = []
    for r in records:
        if not r.missing_text and r.cue.end_ms > r.cue.start_ms:
            caption = "\n".join(line for line in r.cue.text.split("\n") if line.strip()).translate(C1)
            cues.append(replace(r.cue, text=caption))
    ordered = sorted(cues, key=lambda c: c.start_ms)  # stable
    moved = [k for k, (a, b) in enumerate(zip(cues, ordered, strict=True), 1) if a is not b]
    note("ordering", ordinals=moved)
    return Prepared(ordered, ledger)


def import_records(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(doc, srt, cues, records, missing_text, ledger, error, line): each file's canonical text and JSON ledger."""
    import json

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            out = []
            for k in range(len(batch)):
                doc, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    text, encoding = decode(content or b"")
                    records, made = frame(text), prepare(text, encoding)
                    out.append((doc, made.text, len(made.cues), len(records), sum(r.missing_text for r in records), json.dumps(made.ledger, sort_keys=True), None, None))
                except SrtError as error:
                    out.append((doc, None, None, None, None, None, error.kind, error.line))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc", "srt", "cues", "records", "missing_text", "ledger", "error", "line"])

    kinds = "doc string, srt string, cues int, records int, missing_text int, ledger string, error string, line int"
    return files.select(F.col(id_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(rows, kinds)


def reload_records(entries: DataFrame) -> DataFrame:
    """(doc, srt, cues, error) of cached entries, each parsed again from its raw bytes.

    entries has doc, content, size, sha256, ledger (JSON as import_records writes it) and
    fetched_s. An entry counts only if all that was stored about it comes out again:
    otherwise srt and cues are null and error says InvalidProvenance (a null or no
    time of fetching), ContentMismatch (size or digest), LedgerMismatch, or what the parser
    found. Other columns are ignored; of entries that share a doc, all are DuplicateEntry,
    as nothing tells which one was meant. An empty table gives an empty result.
    """
    known = ("doc", "size", "sha256", "ledger", "fetched_s")
    per = entries.select(F.col("doc").cast("string").alias("doc"), "size", "sha256", "ledger", "fetched_s", "content")
    # small columns alone are shuffled; each entry is parsed where it lies
    counted = per.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1 and doc is not null").select("doc", F.lit(True).alias("twice"))
    held = per.withColumn("fault", F.when(F.col("doc").isNull() | F.col("ledger").isNull() | F.coalesce(F.col("fetched_s") <= 0, F.lit(True)), "InvalidProvenance").when(
        ~F.octet_length("content").eqNullSafe(F.col("size").cast("int")) | ~F.sha2("content", 256).eqNullSafe(F.col("sha256")), "ContentMismatch"))
    tagged = held.withColumn("key", F.to_json(F.struct(*known, "fault"), {"ignoreNullFields": "false"}))
    kind = "struct<doc:string,ledger:string,fault:string>"
    made = import_records(tagged, "key").withColumn("was", F.from_json("doc", kind)).drop("doc")
    made = made.select(F.col("was.doc").alias("doc"), "srt", "cues", F.coalesce("was.fault", "error", F.when(~F.col("ledger").eqNullSafe(F.col("was.ledger")), "LedgerMismatch")).alias("fault"))
    made = made.join(counted, "doc", "left").withColumn("error", F.when(F.col("twice"), "DuplicateEntry").otherwise(F.col("fault")))
    kept = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return made.select("doc", kept("srt"), kept("cues"), "error")
