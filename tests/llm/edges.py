"""Small tables with every awkward case, and plain-Python references."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = random.Random(3)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "Épée", "straße", "中文", "x", "don't", "1984", "kappa,", "Omega."]
#: Columns of no meaning whose names clash with the operators' own.
CLASHING = ("id", "k", "h", "n", "node", "kept", "score", "n_words", "label", "shard", "length", "piece", "runs")


def key(x):
    """Sorts None last."""
    return (x is None, x)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(n, rng=PROSE):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 400)) for _ in range(n))


def frame(spark, rows, clash=True):
    """rows of (doc_id, text, lang, source), with clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, lang, source, None) for i, t, lang, source in rows]
    extra = CLASHING if clash else ()
    return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in data], ", ".join([schema, *(f"{c} string" for c in extra)]))


def awkward():
    """Null and repeated ids, null, empty and blank texts, repeats, one very long text."""
    shared, near = prose(70), prose(60)
    long = prose(6000)
    rows = [
        (1, shared, "en", "a"), (2, prose(20) + " " + shared + "\n" + prose(9), "en", "a"), (3, None, "en", None), (4, "", None, "a"), (5, " \t\n ", "de", "b"),
        (6, near, "en", "a"), (7, near.replace(near.split()[30], "changed"), "en", "a"), (8, near, "fr", "b"), (8, near, "fr", "b"), (9, long, "en", "a"), (10, long + " end", "en", "a"),
        (11, "one two three", "en", "a"), (12, "ONE two  three", "en", "a"), (13, "one two", "en", "a"), (None, shared, "en", "a"), (None, None, None, None),
        (14, "line one here\n\nline one here\nother line\n" * 5, "en", "a"), (15, "#$%| <b> *" * 30, "en", "a"), (16, "a" * 3000, "en", "a"), (17, prose(50), "en", "a"), (18, prose(49), "en", "a"),
    ]
    return rows
