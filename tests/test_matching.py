"""The match on invented transcripts: offsets, bands, suppression, ties and bounds."""

import itertools
import random

import pytest

from tideline.limits import DEFAULT_PAIRS, EPISODE_PAIRS
from tideline.operators.alignment import best_chain
from tideline.operators.matching import Index, MatchError

A = ["the brass lantern hung over seven quiet harbours", "nobody counted the herons before winter came back", "a letter arrived folded inside another older letter", "they repaired the clock with borrowed copper wire"]
B = ["green kites climbed above the abandoned salt market", "our neighbour keeps maps of rivers long since dry", "the ferry bell rang twice and then fell silent"]
CUES = "doc string, cue int, start_ms long, text string"


def cues(doc, texts, start=0, step=12_000, starts=None):
    starts = starts or [start + step * k for k in range(len(texts))]
    return [(doc, k, s, t) for k, (s, t) in enumerate(zip(starts, texts, strict=True))]


REFERENCES = cues("a", A, 60_000) + cues("b", B, 120_000)


def match(spark, query, references=REFERENCES, limits=DEFAULT_PAIRS):
    index = Index.build(spark.createDataFrame(references, CUES), 1000)
    return {r.doc: r for r in index.match(spark.createDataFrame(query, CUES), limits).collect()}


def test_outcomes(spark):
    damaged = [t.replace(t.split()[1], "xyzzy") for t in A[:3]]
    got = match(spark, [
        *cues("constant", A[:3]), *cues("jitter", A[:3], starts=[120_999, 133_001, 144_500]), *cues("edge", A[:3], starts=[0, 13_000, 26_000]),
        *cues("rate", A[:3], starts=[0, 15_000, 30_000]), *cues("short", A[:2]), *cues("reversed", A[2::-1]), *cues("close", A[:3], step=1000),
        *cues("repeated", [A[0]] * 5), *cues("damaged", damaged), *cues("upper", [t.upper() for t in A[:3]]), *cues("tie", A[:3] + B), *cues("near", A + B),
        *cues("none", ["nothing here belongs to any of them at all"]), *cues("long", ["word " * 1000 + "end"]), *cues("one", [" ".join(A)]),
    ])
    best = got["constant"].best
    assert (got["constant"].outcome, best.ref, best.score, best.offset_ms, best.spread_ms, got["constant"].coverage) == ("Identified", "a", 3, 60_000, 0, 1.0)
    assert (got["jitter"].best.offset_ms, got["jitter"].best.spread_ms) == (-60_751, 501)
    assert (got["edge"].outcome, got["edge"].best.spread_ms) == ("Identified", 2000)
    for name in ("rate", "short", "reversed", "close", "one"):
        assert got[name].outcome == "Unknown", name
    assert got["repeated"].reason == got["none"].reason == "NoDistinctiveOverlap"
    assert got["damaged"].best.score == got["upper"].best.score == 3
    assert got["tie"].outcome == got["near"].outcome == "Ambiguous"
    assert [c.ref for c in got["tie"].candidates] == ["a", "b"] and got["tie"].coverage == 0.5
    assert (got["long"].outcome, got["long"].reason, got["long"].candidates) == ("Error", "CueTooLarge", None)


def test_shared_and_identical_references_never_win(spark):
    twice = cues("x", A, 0) + cues("y", A, 5000)
    assert match(spark, cues("q", A[:3]), twice)["q"].reason == "NoDistinctiveOverlap"
    stats = Index.build(spark.createDataFrame(twice, CUES), 32).stats.first()
    assert (stats.references, stats.distinctive, stats.repeated) == (2, 0, 0) and stats.shared > 0


def test_index_bounds(spark):
    frame = lambda rows: spark.createDataFrame(rows, CUES)
    for rows, limit, kind in (([], 32, "NoReferences"), (REFERENCES, 1, "TooManyReferences"), (REFERENCES, 0, "limit"), (cues("a", ["x" * 129]), 32, "WordTooLong")):
        with pytest.raises(MatchError, match=kind):
            Index.build(frame(rows), limit)


def test_pair_limits(spark):
    texts = [f"lantern{i} over harbour{i} {i}th evening" for i in range(129)]
    refs, query = cues("r", texts, step=9000), cues("q", texts, step=9000)
    assert match(spark, query, refs)["q"].reason == "TooManyCuePairs"
    assert match(spark, query, refs, EPISODE_PAIRS)["q"].best.score == 129


def brute(q, r, s, separation=8000, spread=2000):
    """Every ordered subset of anchors."""
    best = (0, 0)
    for n in range(1, len(q) + 1):
        for c in itertools.combinations(range(len(q)), n):
            o = [r[k] - q[k] for k in c]
            if max(o) - min(o) <= spread and all(q[b] >= q[a] + separation and r[b] >= r[a] + separation for a, b in itertools.pairwise(c)):
                best = max(best, (n, sum(s[k] for k in c)))
    return best


def test_chain_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        q = sorted(rng.randint(0, 60) * 1000 for _ in range(n))
        r, s = [x + rng.randint(-3, 3) * 700 + 5000 for x in q], [rng.randint(2, 6) for _ in range(n)]
        chain = best_chain(q, r, s)
        assert (len(chain), sum(s[k] for k in chain)) == brute(q, r, s)
