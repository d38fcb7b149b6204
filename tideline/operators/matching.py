"""Which labelled reference, if any, does a timed text come from?

Cues are rows (doc, cue, start_ms, text). Everything up to the alignment is relational: a
reference shingle counts only if it occurs once in the whole reference set, a query
shingle only if it occurs once in its query. The index holds at most 100,000 keys by
contract, which is checked, so it is broadcast; query shingles that no reference holds leave the
plan before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingles, words
from ..functions.timecode import competes
from ..limits import DEFAULT_PAIRS, LIMITS, PairLimits
from .alignment import align


class MatchError(ValueError):
    """The reference set breaks a bound of the data model."""


def cue_segments(texts: DataFrame, doc: str, text: str, spacing_ms: int = 10_000) -> DataFrame:
    """Sentences and lines of plain texts as cues, one every spacing_ms."""
    parts = F.filter(F.split(F.col(text), r"[.\n]+"), lambda s: F.trim(s) != "")
    cues = texts.select(F.col(doc).alias("doc"), F.posexplode(parts).alias("cue", "text"))
    return cues.select("doc", "cue", (F.col("cue") * F.lit(spacing_ms).cast("long")).alias("start_ms"), "text")


def document_status(cues: DataFrame) -> DataFrame:
    """(doc, n_cues, code): OK, or the first bound of the model that a document breaks."""
    # a word of more bytes than allowed has a run of this many letters or digits at least
    run = LIMITS.word_bytes // 4 - 2
    long = F.when(F.col("text").rlike(rf"[\p{{IsAlphabetic}}\p{{N}}]{{{run},}}"), F.array_max(F.transform(words(F.col("text")), F.octet_length)))
    count = F.size(F.filter(F.split("text", r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != ""))
    per = cues.groupBy("doc").agg(
        F.count("*").alias("n_cues"), F.max(F.octet_length("text")).alias("cue_bytes"), F.sum(F.octet_length("text")).alias("bytes"),
        F.sum(count).alias("n_words"), F.max(F.coalesce(long, F.lit(0))).alias("word_bytes"), F.max((F.col("text").rlike(r"[\p{Cc}&&[^\n\t]]")).cast("int")).alias("controls"),
    )
    code = F.when(F.col("n_cues") > LIMITS.cues, "TooManyCues").when((F.col("cue_bytes") > LIMITS.cue_bytes) | (F.col("bytes") > LIMITS.text_bytes), "CueTooLarge").when(F.col("controls") > 0, "ControlCharacter").when(F.col("n_words") > LIMITS.words, "TooManyWords").when(F.col("word_bytes") > LIMITS.word_bytes, "WordTooLong")
    return per.select("doc", "n_cues", code.otherwise("OK").alias("code"))


def shingle_rows(cues: DataFrame) -> DataFrame:
    """One row for each shingle occurrence; shingles never cross cues.

    Words are a column of their own, or every window would split its text anew.
    """
    split = cues.select("doc", "cue", "start_ms", words(F.col("text")).alias("w"))
    return split.select("doc", "cue", "start_ms", F.explode(shingles(F.col("w"))).alias("shingle"))


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc, shingle, n, cue, start_ms): how often a document holds a shingle, and where first."""
    per = rows.groupBy("doc", "shingle").agg(F.count("*").alias("n"), F.min(F.struct("cue", "start_ms")).alias("at"))
    return per.select("doc", "shingle", "n", F.col("at.cue").alias("cue"), F.col("at.start_ms").alias("start_ms"))


def key_rows(references: DataFrame) -> DataFrame:
    """(shingle, owners, n, ref, rcue, r_ms) of every distinct key of the reference set."""
    keys = occurrences(shingle_rows(references)).groupBy("shingle")
    keys = keys.agg(F.count("*").alias("owners"), F.sum("n").alias("n"), F.min(F.struct(F.col("doc").alias("ref"), "cue", "start_ms")).alias("at"))
    return keys.select("shingle", "owners", "n", "at.ref", F.col("at.cue").alias("rcue"), F.col("at.start_ms").alias("r_ms"))


@dataclass(frozen=True)
class Index:
    """Distinctive postings, unique by shingle, and the counters of the whole key set."""

    postings: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, references: DataFrame, limit: int = LIMITS.references) -> Index:
        """references has doc as its id. Raises MatchError where the set breaks a bound."""
        if not 1 <= limit <= LIMITS.references_most:
            raise MatchError("reference limit outside 1..1000")
        keys = key_rows(references).persist()
        broken = document_status(references).filter("code <> 'OK'").select("doc", "code").head()
        if broken:
            raise MatchError(f"reference {broken.doc}: {broken.code}")
        n = references.select("doc").distinct().limit(limit + 1).count()
        if n == 0:
            raise MatchError("NoReferences")
        if n > limit:
            raise MatchError("TooManyReferences")
        stats = index_stats(keys, references)
        got = stats.first()
        if got.distinctive + got.shared + got.repeated > LIMITS.index_keys:
            raise MatchError("TooManyShingles")
        return cls(distinctive(keys), stats)

    def match(self, queries: DataFrame, limits: PairLimits = DEFAULT_PAIRS) -> DataFrame:
        return outcomes(queries, self.postings, limits)


def distinctive(keys: DataFrame) -> DataFrame:
    return keys.filter("n = 1").select("shingle", "ref", "rcue", "r_ms")


def index_stats(keys: DataFrame, references: DataFrame) -> DataFrame:
    """One row: references, distinctive, shared, repeated; a key of several owners is shared, however often."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    counted = keys.agg(one(F.col("n") == 1).alias("distinctive"), one(F.col("owners") > 1).alias("shared"), one((F.col("owners") == 1) & (F.col("n") > 1)).alias("repeated"))
    return references.agg(F.countDistinct("doc").alias("references")).crossJoin(counted)  # one row each


def shingle_hits(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, shingle, qcue, q_ms, ref, rcue, r_ms) of shingles once in the query and once in the index.

    The index is probed first: only occurrences it knows are counted, and only they are shuffled.
    """
    held = shingle_rows(queries).join(F.broadcast(postings), "shingle")
    once = held.groupBy("doc", "shingle").agg(F.count("*").alias("n"), F.min(F.struct("cue", "start_ms", "ref", "rcue", "r_ms")).alias("x")).filter("n = 1")
    return once.select(F.col("doc").alias("query"), "shingle", F.col("x.cue").alias("qcue"), F.col("x.start_ms").alias("q_ms"), "x.ref", "x.rcue", "x.r_ms")


def sound_hits(hits: DataFrame, status: DataFrame) -> DataFrame:
    """Hits of documents within all bounds. Hits are few, so this join spares one of the texts."""
    return hits.join(status.filter("code = 'OK'").select(F.col("doc").alias("query")), "query", "left_semi")


def cue_pairs(hits: DataFrame) -> DataFrame:
    """(query, ref, qcue, rcue, q_ms, r_ms, support): shingles that a pair of cues shares."""
    return hits.groupBy("query", "ref", "qcue", "rcue", "q_ms", "r_ms").agg(F.count("*").alias("support"))


def pair_guard(pairs: DataFrame, limits: PairLimits) -> DataFrame:
    """(query, total, most, exceeded): cue pairs of any support against the limits."""
    per = pairs.groupBy("query", "ref").agg(F.count("*").alias("n")).groupBy("query").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return per.select("query", "total", "most", ((F.col("total") > limits.total) | (F.col("most") > limits.per_reference)).alias("exceeded"))


def candidates(pairs: DataFrame) -> DataFrame:
    """Best chain of each (query, ref) over pairs with a support of two or more."""
    anchors = pairs.filter("support >= 2").groupBy("query", "ref").agg(F.collect_list(F.struct("qcue", "rcue", "q_ms", "r_ms", "support")).alias("anchors"))
    return anchors.select("query", "ref", align("anchors").alias("c")).select("query", "ref", "c.*")


def ranked(found: DataFrame) -> DataFrame:
    """found with rank (score descending, then reference) and the runner-up's score."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("ref"))
    return found.select("*", F.row_number().over(order).alias("rank"), F.lead("score").over(order).alias("next_score"))


def outcomes(queries: DataFrame, postings: DataFrame, limits: PairLimits = DEFAULT_PAIRS) -> DataFrame:
    """One row for each query document: outcome, reasons, best candidate and all candidates.

    Error is an outcome of its own: a document beyond a bound is never called Unknown.
    """
    status = document_status(queries)
    pairs = cue_pairs(sound_hits(shingle_hits(queries, postings), status))
    guard = pair_guard(pairs, limits).filter("exceeded").select(F.col("query").alias("doc"), F.lit("TooManyCuePairs").alias("over"))
    # documents with too many pairs are errors and are never aligned
    found = ranked(candidates(pairs.join(guard.select(F.col("doc").alias("query")), "query", "left_anti")))
    struct = F.struct("rank", "ref", "score", "support", "offset_ms", "spread_ms", "evidence")
    per = found.groupBy(F.col("query").alias("doc")).agg(F.array_sort(F.collect_list(struct)).alias("candidates"), F.max(F.when(F.col("rank") == 1, F.col("next_score"))).alias("runner"))
    rows = status.join(per, "doc", "left").join(guard, "doc", "left")
    best = F.try_element_at("candidates", F.lit(1))
    code = F.coalesce(F.col("over"), F.col("code"))
    outcome = F.when(code != "OK", "Error").when(best.isNull(), "Unknown").when(best["score"] < LIMITS.min_support, "Unknown").when(competes(best["score"], F.col("runner")), "Ambiguous").otherwise("Identified")
    reason = F.when(code != "OK", code).when(best.isNull(), "NoDistinctiveOverlap").when(best["score"] < LIMITS.min_support, "InsufficientSupport").when(outcome == "Ambiguous", "CompetingEvidence")
    rows = rows.select("doc", "n_cues", outcome.alias("outcome"), reason.alias("reason"), F.when(code == "OK", best).alias("best"), F.when(code == "OK", F.col("candidates")).alias("candidates"))
    return rows.withColumn("coverage", F.col("best.score") / F.col("n_cues"))
