"""Clock, tick and rational time arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_ms(stamp: Column, dot: bool = False) -> Column:
    """HH:MM:SS,mmm in exactly twelve bytes as milliseconds, else null."""
    pattern = rf"^(\d\d):([0-5]\d):([0-5]\d){'[,.]' if dot else ','}(\d\d\d)$"
    h, m, s, ms = (F.regexp_extract(stamp, pattern, k).try_cast("long") for k in (1, 2, 3, 4))
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def clock_ms(stamp: Column) -> Column:
    """A padded or unpadded clock with a decimal fraction of 1 to 3 digits as milliseconds, else null."""
    pattern = r"^(\d{1,6}):(\d{1,6}):(\d{1,6})[,.](\d{1,3})$"
    h, m, s = (F.regexp_extract(stamp, pattern, k).try_cast("long") for k in (1, 2, 3))
    fraction = F.rpad(F.regexp_extract(stamp, pattern, 4), 3, "0").try_cast("long")
    total = ((h * 60 + m) * 60 + s) * 1000 + fraction
    return F.when((m < 60) & (s < 60) & (total <= 359_999_999), total)


def timing_row(line: Column) -> Column:
    """struct(start_ms, end_ms, placement) of a timing row, else null.

    placement is X1, X2, Y1, Y2 in that order, none of them reversed, or null.
    """
    clock = r"(\d{1,6}:\d{1,6}:\d{1,6}[,.]\d{1,3})"
    pattern = rf"^[ \t]*{clock}[ \t]*-->[ \t]*{clock}((?:[ \t]+X1:\d+[ \t]+X2:\d+[ \t]+Y1:\d+[ \t]+Y2:\d+)?)[ \t]*$"
    start, end = clock_ms(F.regexp_extract(line, pattern, 1)), clock_ms(F.regexp_extract(line, pattern, 2))
    corners = F.transform(F.regexp_extract_all(F.regexp_extract(line, pattern, 3), F.lit(r":(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    corner = lambda k: F.try_element_at(corners, F.lit(k))
    none = F.size(corners) == 0
    good = start.isNotNull() & end.isNotNull() & (none | ((corner(1) <= corner(2)) & (corner(3) <= corner(4)) & (F.array_max(corners) <= 4294967295)))
    return F.when(good, F.struct(start.alias("start_ms"), end.alias("end_ms"), F.when(~none, corners).alias("placement")))


def stamp(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def decimal_label(text: Column) -> Column:
    """A record label, whole or with a fraction of up to nine digits, as an exact decimal, else null."""
    return F.when(text.rlike(r"^\d{1,10}([.,]\d{1,9})?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(19,9)"))


def floor_ms(ns: Column) -> Column:
    return F.expr("bigint(1000000)") * 0 + F.floor(ns / 1_000_000)


def closed_end(start_ms: Column, end_ms: Column) -> Column:
    """struct(end_ms, synthetic): an absent end or one not after the start becomes start + 1."""
    made = end_ms.isNull() | (end_ms <= start_ms)
    return F.struct(F.when(made, start_ms + 1).otherwise(end_ms).alias("end_ms"), made.alias("synthetic"))


def packet_duration(block: Column, default: Column) -> Column:
    """A block's own duration, even zero, goes before the track's default."""
    return F.coalesce(block, default)


def ticks_ns(cluster: Column, delta: Column, scale: Column) -> Column:
    """(cluster + delta) * scale, null where negative or too large."""
    at = cluster + delta
    return F.when(at >= 0, F.try_multiply(at, scale))


def edited_ns(media: Column, edit_start: Column, edit_length: Column, delay: Column, media_scale: Column, movie_scale: Column) -> Column:
    """Presentation time in ns of a media time under one edit; null outside the edit.

    Media times are in media_scale units, delay and edit_length in movie_scale units; the
    comparison and the sum are exact rationals.
    """
    d = lambda c, p: c.cast(f"decimal({p},0)")
    inside = (media >= edit_start) & (d(media - edit_start, 18) * d(movie_scale, 10) < d(edit_length, 18) * d(media_scale, 10))
    total = d(delay, 14) * d(media_scale, 10) + d(media - edit_start, 14) * d(movie_scale, 10)
    whole = F.floor(total.cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") / (d(media_scale, 10) * d(movie_scale, 10)))
    return F.when(inside, whole.cast("long"))


def offset_midpoint(least: Column, most: Column) -> Column:
    """The middle of a range of offsets; only the non-negative width is divided."""
    return least + F.floor((most - least) / 2)


def competes(best: Column, runner: Column, least: int = 3) -> Column:
    """Is the second candidate so near the first that neither may be named?"""
    return F.coalesce((runner >= least) & ((runner + 1 >= best) | (5 * runner >= 4 * best)), F.lit(False))
