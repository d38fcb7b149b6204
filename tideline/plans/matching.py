"""The match over documents and benchmark, stage by stage, each with its SQL.

A document's sentences and lines are its cues, ten seconds apart; benchmark items are the
references. With that spacing a band of two seconds holds one diagonal, so the chain of the
alignment is all anchors of the diagonal with most of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shingles, words
from ..limits import EPISODE_PAIRS, LIMITS
from ..operators import matching as m
from ..shipping import ship


def _cues(spark: SparkSession, sf: str, table: str = "documents", doc: str = "doc_id") -> DataFrame:
    return m.cue_segments(spark.read.parquet(f"{sf}/{table}.parquet"), doc, "text")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return _cues(spark, sf, "benchmark", "item_id")


def _index(spark: SparkSession, sf: str) -> m.Index:
    return m.Index.build(_refs(spark, sf), LIMITS.references_most)


def _hits(spark, sf) -> DataFrame:
    cues = _cues(spark, sf)
    return m.sound_hits(m.shingle_hits(cues, _index(spark, sf).postings), m.document_status(cues))


def cue_segments(spark, sf):
    return _cues(spark, sf)


def tokens(spark, sf):
    return _cues(spark, sf).select("doc", "cue", F.posexplode(words(F.col("text"))).alias("position", "word"))


def shingle_counts(spark, sf):
    made = _cues(spark, sf).select("doc", words(F.col("text")).alias("w")).select("doc", F.size(shingles(F.col("w"))).alias("n"))
    return made.groupBy("doc").agg(F.sum("n").alias("n_shingles"))


def shingle_occurrences(spark, sf):
    return m.occurrences(m.shingle_rows(_refs(spark, sf)))


def distinctive_postings(spark, sf):
    return _index(spark, sf).postings


def index_stats(spark, sf):
    return _index(spark, sf).stats


def query_unique_shingles(spark, sf):
    return m.occurrences(m.shingle_rows(_cues(spark, sf, "conversations", "conv_id"))).filter("n = 1").groupBy("doc").agg(F.count("*").alias("n_unique"))


def shingle_join(spark, sf):
    return _hits(spark, sf)


def anchor_pairs(spark, sf):
    return m.cue_pairs(_hits(spark, sf)).filter("support >= 2")


def pair_limit_guard(spark, sf):
    return m.pair_guard(m.cue_pairs(_hits(spark, sf)), EPISODE_PAIRS)


def alignment_scores(spark, sf):
    ship(spark)
    return m.candidates(m.cue_pairs(_hits(spark, sf))).select("query", "ref", "score", "support", "offset_ms", "spread_ms", "q_first", "r_last")


def candidate_rank(spark, sf):
    ship(spark)
    return m.ranked(m.candidates(m.cue_pairs(_hits(spark, sf)))).select("query", "ref", "score", "rank", "next_score")


def match_outcome(spark, sf):
    ship(spark)
    found = _index(spark, sf).match(_cues(spark, sf), EPISODE_PAIRS)
    return found.select("doc", "n_cues", "outcome", "reason", F.col("best.ref").alias("ref"), F.col("best.score").alias("score"), F.col("best.offset_ms").alias("offset_ms"), "coverage")


def outcome_tally(spark, sf):
    return match_outcome(spark, sf).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def document_status(spark, sf):
    return m.document_status(_cues(spark, sf))


def jittered_alignment(spark, sf):
    """Cues start after the words before them, 400 ms a word, so offsets spread and bands matter."""
    ship(spark)
    from pyspark.sql import Window

    def timed(cues):
        before = Window.partitionBy("doc").orderBy("cue").rowsBetween(Window.unboundedPreceding, -1)
        return cues.withColumn("start_ms", F.coalesce(F.sum(F.size(words(F.col("text")))).over(before), F.lit(0)) * 400)

    index = m.Index.build(timed(_refs(spark, sf)), LIMITS.references_most)
    cues = timed(_cues(spark, sf))
    hits = m.sound_hits(m.shingle_hits(cues, index.postings), m.document_status(cues))
    return m.candidates(m.cue_pairs(hits)).select("query", "ref", "score", "support")


QUERIES = {f.__name__: f for f in (cue_segments, tokens, shingle_counts, shingle_occurrences, distinctive_postings, index_stats, query_unique_shingles, shingle_join, anchor_pairs, pair_limit_guard, alignment_scores, candidate_rank, match_outcome, outcome_tally, document_status, jittered_alignment)}


def _cue_sql(name: str, table: str, doc: str, timed: bool = False) -> str:
    start = "coalesce(sum(len(ws)) OVER (PARTITION BY doc ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 400" if timed else "cue * 10000"
    return rf"""{name}_raw AS (
  SELECT {doc} AS doc, unnest(list_filter(string_split_regex(text, '[.\n]+'), lambda s: trim(s, ' ') <> '')) AS text, generate_subscripts(list_filter(string_split_regex(text, '[.\n]+'), lambda s: trim(s, ' ') <> ''), 1) - 1 AS cue FROM {table}
), {name}_words AS (
  SELECT doc, cue, text, list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: lower(w)) AS ws FROM {name}_raw
), {name} AS (
  SELECT doc, CAST(cue AS INTEGER) AS cue, CAST({start} AS BIGINT) AS start_ms, text, ws FROM {name}_words
)"""


def _shingle_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT doc, cue, start_ms, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS shingle
  FROM (SELECT doc, cue, start_ms, ws, unnest(range(1, len(ws) - 1)) AS i FROM {source} WHERE len(ws) >= 3)
)"""


_STATUS = f"""status AS (
  SELECT doc, count(*) AS n_cues, CASE WHEN count(*) > {LIMITS.cues} THEN 'TooManyCues'
    WHEN max(octet_length(encode(text))) > {LIMITS.cue_bytes} OR sum(octet_length(encode(text))) > {LIMITS.text_bytes} THEN 'CueTooLarge'
    WHEN sum(len(ws)) > {LIMITS.words} THEN 'TooManyWords'
    WHEN max(coalesce(list_max(list_transform(ws, lambda w: octet_length(encode(w)))), 0)) > {LIMITS.word_bytes} THEN 'WordTooLong' ELSE 'OK' END AS code
  FROM cues GROUP BY doc
)"""


def _base(timed: bool = False) -> str:
    return ",\n".join([
        _cue_sql("cues", "documents", "doc_id", timed), _cue_sql("refs", "benchmark", "item_id", timed), _shingle_sql("rs", "refs"), _STATUS,
        "sound AS (SELECT * FROM cues WHERE doc IN (SELECT doc FROM status WHERE code = 'OK'))", _shingle_sql("qs", "sound"),
        "postings AS (SELECT shingle, min(doc) AS ref, min(cue) AS rcue, min(start_ms) AS r_ms FROM rs GROUP BY shingle HAVING count(*) = 1)",
        "uniq AS (SELECT doc AS query, shingle, min(cue) AS qcue, min(start_ms) AS q_ms FROM qs GROUP BY doc, shingle HAVING count(*) = 1)",
        "hits AS (SELECT query, shingle, qcue, q_ms, ref, rcue, r_ms FROM uniq JOIN postings USING (shingle))",
        "pairs AS (SELECT query, ref, qcue, rcue, q_ms, r_ms, count(*) AS support FROM hits GROUP BY ALL)",
        "diag AS (SELECT query, ref, r_ms - q_ms AS offset_ms, count(*) AS score, CAST(sum(support) AS BIGINT) AS support, min(q_ms) AS q_first, max(r_ms) AS r_last FROM pairs WHERE support >= 2 GROUP BY ALL)",
        "best AS (SELECT query, ref, CAST(score AS INTEGER) AS score, support, offset_ms, CAST(0 AS BIGINT) AS spread_ms, q_first, r_last FROM diag QUALIFY row_number() OVER (PARTITION BY query, ref ORDER BY score DESC, support DESC, offset_ms) = 1)",
        "ranks AS (SELECT query, ref, score, offset_ms, CAST(row_number() OVER w AS INTEGER) AS rank, lead(score) OVER w AS next_score FROM best WINDOW w AS (PARTITION BY query ORDER BY score DESC, ref))",
        "over AS (SELECT query FROM (SELECT query, ref, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY query HAVING sum(n) > 4096 OR max(n) > 1024)",
        """outcome AS (SELECT doc, n_cues, CASE WHEN code <> 'OK' OR o.query IS NOT NULL THEN 'Error' WHEN score IS NULL OR score < 3 THEN 'Unknown'
          WHEN next_score >= 3 AND (next_score + 1 >= score OR 5 * next_score >= 4 * score) THEN 'Ambiguous' ELSE 'Identified' END AS outcome,
          CASE WHEN o.query IS NOT NULL THEN 'TooManyCuePairs' WHEN code <> 'OK' THEN code WHEN score IS NULL THEN 'NoDistinctiveOverlap' WHEN score < 3 THEN 'InsufficientSupport'
          WHEN next_score >= 3 AND (next_score + 1 >= score OR 5 * next_score >= 4 * score) THEN 'CompetingEvidence' END AS reason, ref, score, offset_ms, score / n_cues AS coverage
          FROM status LEFT JOIN (SELECT * FROM ranks WHERE rank = 1) r ON r.query = doc LEFT JOIN over o ON o.query = doc)""",
    ])


def _sql(select: str) -> str:
    return f"WITH {_base()}\n{select}"


ORACLE_SQL = {
    "cue_segments": f"WITH {_cue_sql('cues', 'documents', 'doc_id')} SELECT doc, cue, start_ms, text FROM cues",
    "tokens": f"WITH {_cue_sql('cues', 'documents', 'doc_id')} SELECT doc, cue, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS position, unnest(ws) AS word FROM cues",
    "shingle_counts": f"WITH {_cue_sql('cues', 'documents', 'doc_id')} SELECT doc, CAST(sum(greatest(len(ws) - 2, 0)) AS BIGINT) AS n_shingles FROM cues GROUP BY doc",
    "shingle_occurrences": _sql("SELECT doc, shingle, count(*) AS n, min(cue) AS cue, min(start_ms) AS start_ms FROM rs GROUP BY doc, shingle"),
    "distinctive_postings": _sql("SELECT * FROM postings"),
    "index_stats": _sql('SELECT (SELECT count(DISTINCT doc) FROM refs) AS "references", count(*) FILTER (n = 1) AS distinctive, count(*) FILTER (owners > 1) AS shared, count(*) FILTER (owners = 1 AND n > 1) AS repeated FROM (SELECT shingle, count(DISTINCT doc) AS owners, count(*) AS n FROM rs GROUP BY shingle)'),
    "query_unique_shingles": f"WITH {_cue_sql('cs', 'conversations', 'conv_id')}, {_shingle_sql('s', 'cs')} SELECT doc, count(*) AS n_unique FROM (SELECT doc, shingle FROM s GROUP BY doc, shingle HAVING count(*) = 1) GROUP BY doc",
    "shingle_join": _sql("SELECT * FROM hits"),
    "anchor_pairs": _sql("SELECT * FROM pairs WHERE support >= 2"),
    "pair_limit_guard": _sql("SELECT query, CAST(sum(n) AS BIGINT) AS total, max(n) AS most, sum(n) > 4096 OR max(n) > 1024 AS exceeded FROM (SELECT query, ref, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY query"),
    "alignment_scores": _sql("SELECT * FROM best"),
    "candidate_rank": _sql("SELECT query, ref, score, rank, next_score FROM ranks"),
    "match_outcome": _sql("SELECT * FROM outcome"),
    "outcome_tally": _sql("SELECT outcome, reason, count(*) AS n FROM outcome GROUP BY ALL"),
    "document_status": _sql("SELECT * FROM status"),
    # every chain of a band is walked; anchors are few
    "jittered_alignment": f"""WITH RECURSIVE {_base(timed=True)}, a AS (
  SELECT query, ref, qcue, rcue, q_ms, r_ms, support FROM pairs WHERE support >= 2
), bands AS (SELECT DISTINCT query, ref, r_ms - q_ms AS low FROM a),
chain AS (
  SELECT b.query, b.ref, b.low, a.q_ms, a.r_ms, 1 AS score, CAST(a.support AS BIGINT) AS support FROM a JOIN bands b ON a.query = b.query AND a.ref = b.ref AND a.r_ms - a.q_ms BETWEEN b.low AND b.low + 2000
  UNION
  SELECT c.query, c.ref, c.low, a.q_ms, a.r_ms, c.score + 1, c.support + a.support FROM chain c JOIN a ON a.query = c.query AND a.ref = c.ref
  WHERE a.r_ms - a.q_ms BETWEEN c.low AND c.low + 2000 AND a.q_ms >= c.q_ms + 8000 AND a.r_ms >= c.r_ms + 8000
)
SELECT query, ref, CAST(score AS INTEGER) AS score, support FROM chain QUALIFY row_number() OVER (PARTITION BY query, ref ORDER BY score DESC, support DESC) = 1""",
}
