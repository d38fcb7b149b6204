"""Temporal alignment: the best ordered chain of anchors within one offset band.

Anchors (q_ms, r_ms, support) pair a query cue with a reference cue. For every distinct
offset r - q, taken as the lower end of a band of `spread` ms, the longest chain of
anchors of the band is sought whose steps are `separation` ms or more on both sides;
among chains of equal length the larger total support wins, then the lower band, then the
chain that ends first. One array of anchors, of bounded size, is all a row needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import LIMITS

_LONGS = ("query_start_ms", "reference_start_ms", "distinct_shingles")
CHAIN = T.StructType([
    T.StructField("score", T.IntegerType()),
    *(T.StructField(c, T.LongType()) for c in ("support", "offset_ms", "spread_ms", "q_first", "q_last", "r_first", "r_last")),
    T.StructField("evidence", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _LONGS]))),
])


def best_chain(q: Sequence[int], r: Sequence[int], support: Sequence[int], separation: int = LIMITS.min_separation_ms, spread: int = LIMITS.max_spread_ms) -> list[int]:
    """Positions of the best chain; anchors come ordered by query cue, then reference cue."""
    q, r, support = (np.asarray(x, dtype=np.int64) for x in (q, r, support))
    offset = r - q
    best: tuple[int, int] = (0, 0)
    chain: list[int] = []
    for low in np.unique(offset):
        band = np.flatnonzero((offset >= low) & (offset <= low + spread))
        length, total, last = np.ones(len(band), np.int64), support[band].copy(), np.full(len(band), -1)
        for i in range(len(band)):
            before = np.flatnonzero((q[band[:i]] + separation <= q[band[i]]) & (r[band[:i]] + separation <= r[band[i]]))
            if len(before):
                # lexsort's last key leads; -before prefers the first of equals
                j = before[np.lexsort((-before, total[before], length[before]))[-1]]
                length[i], total[i], last[i] = length[j] + 1, total[j] + support[band[i]], j
        for i in range(len(band)):
            if (length[i], total[i]) > best:
                best, chain, k = (int(length[i]), int(total[i])), [], i
                while k >= 0:
                    chain.append(int(band[k]))
                    k = last[k]
    return chain[::-1]


@F.pandas_udf(CHAIN)
def align(anchors: pd.Series) -> pd.DataFrame:
    """Best chain of an array of struct(qcue, rcue, q_ms, r_ms, support); null for no anchors."""
    out = []
    for row in anchors:
        if row is None or not len(row):
            out.append(None)
            continue
        row = sorted(row, key=lambda a: (a["qcue"], a["rcue"]))
        q, r, s = ([a[c] for a in row] for c in ("q_ms", "r_ms", "support"))
        chain = best_chain(q, r, s)
        offsets = [r[k] - q[k] for k in chain]
        low, high = min(offsets), max(offsets)
        out.append({
            "score": len(chain), "support": sum(s[k] for k in chain), "offset_ms": low + (high - low) // 2, "spread_ms": high - low,
            "q_first": q[chain[0]], "q_last": q[chain[-1]], "r_first": r[chain[0]], "r_last": r[chain[-1]],
            "evidence": [{"query_start_ms": q[k], "reference_start_ms": r[k], "distinct_shingles": s[k]} for k in chain],
        })
    names = ["score", "support", "offset_ms", "spread_ms", "q_first", "q_last", "r_first", "r_last", "evidence"]
    return pd.DataFrame([o or dict.fromkeys(names) for o in out], columns=names)
