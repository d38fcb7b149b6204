"""The match as a stream: cues arrive in order, and every batch is judged on all cues so far.

More cues can void what fewer supported, so nothing is added up: state holds the cues,
at most as many as a transcript may have, and each update matches them anew. An update is
provisional; the last one of a finished stream equals the batch result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..limits import EPISODE_PAIRS, LIMITS, PairLimits
from ..operators.alignment import best_chain

#: How many frames are tried before each assessment.
CHECKPOINTS = (64, 128, 192)
UPDATE = "doc string, cues int, outcome string, ref string, score int, error string"
_STATE = "starts array<long>, texts array<string>"


def tokens(text: str) -> list[str]:
    """Words of a text, cut at whatever is neither letter, mark of a letter nor number, then lower-cased."""
    import regex

    return [w.lower() for w in regex.findall(r"[\p{Alphabetic}\p{N}]+", text)]


def assess(starts: Sequence[int], texts: Sequence[str], postings: dict[str, tuple], limits: PairLimits = EPISODE_PAIRS) -> tuple[str, str | None, int | None, str | None]:
    """(outcome, reference, score, error) of cues against postings: shingle -> (reference, cue, start)."""
    held: dict[str, list[int]] = defaultdict(list)
    for cue, text in enumerate(texts):
        w = tokens(text)
        for s in zip(w, w[1:], w[2:], strict=False):
            held[" ".join(s)].append(cue)
    pairs = Counter((postings[s][0], cues[0], *postings[s][1:]) for s, cues in held.items() if len(cues) == 1 and s in postings)
    per = Counter(ref for ref, *_ in pairs)
    if sum(per.values()) > limits.total or max(per.values(), default=0) > limits.per_reference:
        return "Error", None, None, "TooManyCuePairs"
    ranked = []
    for ref in per:
        anchors = sorted((q, rcue, r, n) for (x, q, rcue, r), n in pairs.items() if x == ref and n >= 2)
        if anchors:
            chain = best_chain([starts[a[0]] for a in anchors], [a[2] for a in anchors], [a[3] for a in anchors])
            ranked.append((-len(chain), ref))
    ranked.sort()
    if not ranked or -ranked[0][0] < LIMITS.min_support:
        return "Unknown", None, None, None
    best, runner = -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else 0
    if runner >= LIMITS.min_support and (runner + 1 >= best or 5 * runner >= 4 * best):
        return "Ambiguous", None, best, None
    return "Identified", ranked[0][1], best, None


def match_stream(cues: DataFrame, postings: DataFrame, limits: PairLimits = EPISODE_PAIRS) -> DataFrame:
    """Updates for a stream of cues (doc, cue, start_ms, text); one for each document a batch touches.

    postings is an index of at most 100,000 keys, so it travels with the function. Cues
    may only follow those that came before; an earlier start is an error that stays.
    """
    rows = postings.limit(LIMITS.index_keys + 1).collect()
    if len(rows) > LIMITS.index_keys:
        raise ValueError("TooManyShingles")
    known = cues.sparkSession.sparkContext.broadcast({r.shingle: (r.ref, r.rcue, r.r_ms) for r in rows})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, texts = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(batches).sort_values("cue", kind="stable")
        error = None
        if starts and starts[0] < 0:
            error = "InvalidTiming"
        for start, text in zip(new["start_ms"], new["text"], strict=True):
            if error is None and ((starts and start < starts[-1]) or len(starts) == LIMITS.cues):
                error, starts, texts = "InvalidTiming" if starts and start < starts[-1] else "TooManyCues", [-1], [""]
            if error is None:
                starts.append(int(start))
                texts.append(text or "")
        state.update((starts, texts))
        found = ("Error", None, None, error) if error else assess(starts, texts, known.value, limits)
        yield pd.DataFrame([(key[0], len(starts), *found)], columns=["doc", "cues", "outcome", "ref", "score", "error"])

    rows = cues.select("doc", "cue", "start_ms", "text")
    return rows.groupBy("doc").applyInPandasWithState(update, UPDATE, _STATE, "append", GroupStateTimeout.NoTimeout)


def progressive(cues: Sequence[tuple[int, str]], postings: dict[str, tuple], at: Sequence[int] = CHECKPOINTS) -> tuple[int, tuple]:
    """(cues used, assessment) at the first checkpoint that identifies, else at the last one or the end."""
    for n in at:
        found = assess([s for s, _ in cues[:n]], [t for _, t in cues[:n]], postings)
        if found[0] == "Identified" or n >= len(cues):
            break
    return min(n, len(cues)), found
