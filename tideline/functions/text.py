"""Text functions as column expressions; Python only where no built-in can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Named character references that titles may hold.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def words(text: Column) -> Column:
    """Words of a text, lower-cased after the split: lower-casing first would break words at marks it adds."""
    return F.transform(F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != ""), F.lower)


def shingles(tokens: Column, width: int = 3) -> Column:
    """Windows of `width` words joined by one space, none for fewer words."""
    last = F.size(tokens) - (width - 1)
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice(tokens, i, width)))
    return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))


def trimmed(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def has_control(text: Column, allow_line_tab: bool = False) -> Column:
    return text.rlike(r"[\p{Cc}&&[^\n\t]]" if allow_line_tab else r"\p{Cc}")


def clean_name(text: Column, most_bytes: int = 1024) -> Column:
    """Is it a valid display text: not blank, trimmed, short enough and without controls?"""
    return (text != "") & (trimmed(text) == text) & (F.octet_length(text) <= most_bytes) & ~has_control(text)


def namespace_ok(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._-]{1,64}$")


def safe_component(name: Column) -> Column:
    """A file name part: characters that systems refuse become _, and no dot or space ends it."""
    shown = F.regexp_replace(name, r'[<>:"/\\|?*\p{Cc}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', "_")
    return F.regexp_replace(trimmed(shown), r"[. ]+$", "")


def collision_key(name: Column) -> Column:
    """What two names share when a file system may take them for one."""
    return F.upper(F.regexp_replace(name, r"[. ]+$", ""))


def code_label(season: Column, episode: Column, title: Column) -> Column:
    return F.format_string("S%02dE%02d %s", season, episode, title)


def parse_label(label: Column) -> Column:
    """struct(season, episode, title) of a label that code_label() would write, else null."""
    part = lambda k: F.regexp_extract(label, r"^S(\d{2,3})E(\d{2,4}) (.+)$", k)
    season, episode, title = part(1).try_cast("int"), part(2).try_cast("int"), part(3)
    good = (season >= 1) & (episode >= 1) & (code_label(season, episode, title) == label)
    return F.when(good, F.struct(season.alias("season"), episode.alias("episode"), title.alias("title")))


def form_encode(text: Column) -> Column:
    """Form encoding: letters, digits, - . _ ~ stay, a space becomes +, other bytes %XX."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def same_ascii(a: Column, b: Column) -> Column:
    """Equality that ignores the case of A-Z alone."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def replace_c1(text: Column) -> Column:
    """Two stray C1 codes become the replacement character."""
    return F.translate(text, "\u0092\u009d", "��")


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: trimmed(line) != ""), "\n")


def line_feeds(text: Column, lone_cr: bool = True) -> Column:
    """CRLF, and on request a lone CR, as LF."""
    return F.regexp_replace(text, "\r\n|\r" if lone_cr else "\r\n", "\n")


def imdb_number(text: Column) -> Column:
    """tt and 1 to 10 digits, from 1 to 2**31 - 1, as a number, else null."""
    n = F.regexp_extract(text, r"^tt(\d{1,10})$", 1).try_cast("long")
    return F.when(n.between(1, 2147483647), n)


def bounded_int(text: Column, low: int, high: int) -> Column:
    """Plain digits within bounds as a number, else null: no sign, no spaces."""
    n = F.when(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("long"))
    return F.when(n.between(low, high), n)


@F.pandas_udf(StringType())
def decode_references(titles: pd.Series) -> pd.Series:
    """One pass over character references; those that name controls or surrogates stay as they are."""
    import re

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return NAMED.get(body, m[0])
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        bad = code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or code < 32 or 127 <= code < 160
        return m[0] if bad else chr(code)

    pattern = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]{2,4});")
    return titles.map(lambda t: t if t is None else pattern.sub(one, t))


def titles_agree(a: Column, b: Column) -> Column:
    return (a == b) | (decode_references(a) == decode_references(b))


@F.pandas_udf(StringType())
def shown(texts: pd.Series) -> pd.Series:
    """Controls and bidirectional marks written out as code points, for display."""
    import re

    pattern = re.compile("[\x00-\x1f\x7f-\x9f؜‎‏‪-‮⁦-⁩]")
    return texts.map(lambda t: t if t is None else pattern.sub(lambda m: f"⟦U+{ord(m[0]):04X}⟧", t))


@F.pandas_udf(StringType())
def file_name(series: pd.Series, code: pd.Series, title: pd.Series, ext: pd.Series) -> pd.Series:
    """series - code - title.ext in at most 240 bytes; the title gives way, cut between characters."""

    def one(s: str, c: str, t: str, e: str) -> str | None:
        if None in (s, c, t, e):
            return None
        frame = f"{s} - {c} - ".encode(), f".{e}".encode()
        room = max(0, 240 - sum(map(len, frame)))
        cut = t.encode()[:room].decode("utf-8", "ignore").rstrip(". ")
        return frame[0].decode() + cut + frame[1].decode()

    return pd.Series([one(*x) for x in zip(series, code, title, ext, strict=True)])


def label_tokens(name: Column) -> Column:
    """Episode labels named in a file name: sNNeMM or NxM, as struct(season, episode), distinct."""
    low = F.lower(name)
    pairs = lambda pattern, a, b: F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(a)).alias("season"), F.regexp_extract_all(low, F.lit(pattern), F.lit(b)).alias("episode"))
    found = F.concat(pairs(r"(?<![a-z0-9])s(\d{1,2})[ ._-]?e(\d{1,3})(?![0-9])", 1, 2), pairs(r"(?<![a-z0-9])(\d{1,2})x(\d{1,3})(?![0-9])", 1, 2))
    return F.array_distinct(F.transform(found, lambda x: F.struct(x["season"].cast("int").alias("season"), x["episode"].cast("int").alias("episode"))))


def label_conflict(name: Column, season: Column, episode: Column) -> Column:
    """Does a release name speak for another episode, several episodes or a whole pack?"""
    labels = label_tokens(name)
    pack = F.lower(name).rlike(r"(?<![a-z])(complete (series|season)|season pack|all episodes)(?![a-z])|(?<![a-z0-9])s\d{1,2}[ ._-]?e\d{1,3} ?- ?e?\d{1,3}(?![0-9])")
    other = F.exists(labels, lambda x: (x["season"] != season) | (x["episode"] != episode))
    return F.coalesce(pack | other | (F.size(labels) > 1), F.lit(False))
