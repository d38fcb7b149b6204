"""Text and container formats over the driver's tables: written, damaged, read back, each with its SQL.

Benchmark items are cut into cues of one second, ten seconds apart.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..limits import LIMITS
from ..operators.matching import cue_segments
from ..shipping import ship
from ..sources import matroska, records, srt
from .matching import _cue_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_CUES = f"WITH {_cue_sql('c', 'benchmark', 'item_id')}, cues AS (SELECT CAST(doc AS VARCHAR) AS doc, cue, start_ms, start_ms + 1000 AS end_ms, text FROM c)"
_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_SRT = f"string_agg(CAST(cue + 1 AS VARCHAR) || chr(10) || {_STAMP.format('start_ms')} || ' --> ' || {_STAMP.format('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY cue)"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _cues(spark, sf: str) -> DataFrame:
    cues = cue_segments(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text")
    return cues.select(F.col("doc").cast("string").alias("doc"), "cue", "start_ms", (F.col("start_ms") + 1000).alias("end_ms"), "text")


@query(f"{_CUES} SELECT doc, {_SRT} AS srt FROM cues GROUP BY doc")
def srt_render(spark, sf):
    """Canonical text."""
    return srt.render(_cues(spark, sf))


@query(f"{_CUES} SELECT doc, cue, start_ms, end_ms, text FROM cues")
def srt_round_trip(spark, sf):
    """The strict reader on what was written."""
    ship(spark)
    files = srt.render(_cues(spark, sf)).select(F.col("doc").alias("path"), F.encode("srt", "UTF-8").alias("content"))
    return srt.read_srt(files).filter("error is null").select("doc", "cue", "start_ms", "end_ms", "text")


@query(f"{_CUES} SELECT doc, {_SRT} AS srt, CAST(count(*) AS INTEGER) AS cues, CAST(count(*) AS INTEGER) AS records FROM cues GROUP BY doc")
def lenient_import(spark, sf):
    """Separators and padding taken out, CRLF put in; the import gives the canonical text again."""
    ship(spark)
    damaged = F.regexp_replace(F.regexp_replace(F.col("srt"), "\n\n", "\n"), "(?m)^00:00:", "0:0:")
    files = srt.render(_cues(spark, sf)).select(F.col("doc").alias("path"), F.encode(F.replace(damaged, F.lit("\n"), F.lit("\r\n")), "UTF-8").alias("content"))
    return records.import_records(files).select("doc", "srt", "cues", "records")


@query(f"""WITH {_cue_sql('c', 'documents', 'doc_id')} SELECT doc, CASE WHEN min(cue) FILTER (b) IS NOT NULL THEN 'LimitExceeded' END AS error, CAST(min(cue) FILTER (b) + 1 AS INTEGER) AS cue
FROM (SELECT doc, cue, octet_length(encode(text)) > {LIMITS.cue_bytes} OR sum(octet_length(encode(text))) OVER (PARTITION BY doc ORDER BY cue) > {LIMITS.text_bytes} OR cue >= {LIMITS.cues} AS b FROM c) GROUP BY doc""")
def checked_cues(spark, sf):
    """The first cue of a document that breaks a bound."""
    cues = cue_segments(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    return srt.check_cues(cues.withColumn("end_ms", F.col("start_ms") + 1000).filter(F.size(words(F.col("text"))) >= 0))


def _files(cues: DataFrame) -> DataFrame:
    """One Matroska file of each document's cues."""
    track = {"number": 2, "uid": 2, "type": 17, "codec": "S_TEXT/UTF8", "language": "eng"}

    def build(table: pa.Table) -> pa.Table:
        rows = table.sort_by("cue").to_pylist()
        frames = [matroska.Frame(2, r["start_ms"] * 1_000_000, True, (r["end_ms"] - r["start_ms"]) * 1_000_000, r["text"].encode()) for r in rows]
        return pa.table({"path": [rows[0]["doc"]], "content": pa.array([matroska.mux([track], frames)], pa.binary())})

    return cues.groupBy("doc").applyInArrow(build, "path string, content binary")


@query(f"{_CUES} SELECT doc, cue, start_ms, end_ms, text, start_ms * 1000000 AS start_ns, false AS synthetic FROM cues")
def mkv_round_trip(spark, sf):
    """A file of every document, written and read back."""
    ship(spark)
    return matroska.extract(_files(_cues(spark, sf))).select("doc", "cue", "start_ms", "end_ms", "text", "start_ns", "synthetic")


@query(f"{_CUES} SELECT doc, CAST(count(*) AS BIGINT) AS packets, max(end_ms) * 1000000 AS until_ns FROM cues GROUP BY doc")
def mkv_packets(spark, sf):
    """The lenient walk sees the same packets."""
    ship(spark)
    p = matroska.packets(_files(_cues(spark, sf)), strict=False)
    return p.groupBy("doc").agg(F.count("*").alias("packets"), F.max(F.col("ts_ns") + F.coalesce("duration_ns", F.lit(0))).alias("until_ns"))
