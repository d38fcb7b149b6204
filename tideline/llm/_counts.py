"""Counts of whole texts that the quality operators share, vectorised over a slice of rows."""

from __future__ import annotations

import numpy as np

from ._text import BYTE_BASE, IS_SPACE, Words, prefix, span_hashes

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags within each row's bytes or words."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def among(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table[data]


def repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is its value found twice or more in its row; has it come before in sort order."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    many, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    many[order] = same[1:] | same[:-1]
    again[order] = same[:-1]
    return many, again


def line_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the row."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where(np.isin(ends - 1, breaks) & (ends > starts), ends - 1, ends)
    solid = np.concatenate([[0], np.cumsum(~IS_SPACE[data])])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    _, again = repeats(doc, span_hashes(prefix(data, BYTE_BASE), starts, ends, BYTE_BASE))
    rows = len(offsets) - 1
    return np.bincount(doc, minlength=rows), np.bincount(doc[again], minlength=rows)


def repeat_words(words: Words, width: int = 8) -> np.ndarray:
    """Words of each row that lie in a window of `width` words found twice or more in it."""
    h, inside = words.windows(width)
    at = np.flatnonzero(inside)
    many, _ = repeats(words.doc[at], h[at])
    step = np.zeros(len(words.starts) + 1, np.int64)
    step[at[many]] += 1
    step[at[many] + width] -= 1
    return per_row(np.cumsum(step)[:-1] > 0, words.first)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper of each row."""
    data, offsets = words.data, words.offsets
    lines, dup_lines = line_counts(words)
    return {
        "n_words": words.count,
        "word_chars": per_row(~IS_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(among(data, SYMBOLS), offsets),
        "n_lines": lines,
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words(words),
        "n_upper": per_row((data >= 65) & (data <= 90), offsets),
    }
