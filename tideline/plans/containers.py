"""MP4 files, bitmap subtitles, catalog answers and published tables, made of the driver's tables and read back, each with its SQL.

Cues are those of `media`; catalog answers list the nations, ten to a page.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..shared import fresh_path
from ..shipping import ship
from ..sources import catalog, folder, matroska, mp4, pgs
from .media import _CUES, _cues, _files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Time units a second of the films made here: of the movie, and of its text track, which counts in ms.
MOVIE_SCALE, MEDIA_SCALE = 600, 1000


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _words(*numbers: int) -> bytes:
    return struct.pack(f">{len(numbers)}I", *numbers)


def _full(kind: bytes, *body: bytes) -> bytes:
    return mp4.box(kind, b"\0\0\0\0", *body)


def film(texts: list[str], skip_ms: int | None = None, delay_ms: int = 0) -> bytes:
    """An MP4 file that shows each text for one second and nothing for nine.

    With skip_ms an edit list leaves out that much of the beginning, after an empty edit of delay_ms.
    """
    samples = [s for t in texts for s in (t.encode(), b"")]
    media = b"".join(struct.pack(">H", len(s)) + s for s in samples)
    timing = [x for _ in texts for x in (1, 1000, 1, 9000)]
    total = 10_000 * len(texts)
    description = mp4.box(b"tx3g", b"\0" * 6 + b"\0\1", b"\0" * 30)
    top = mp4.box(b"ftyp", b"isom")
    stbl = mp4.box(
        b"stbl", _full(b"stsd", _words(1), description), _full(b"stts", _words(len(samples), *timing)), _full(b"stsc", _words(1, 1, len(samples), 1)),
        _full(b"stsz", _words(0, len(samples), *(2 + len(s) for s in samples))), _full(b"stco", _words(1, len(top) + 8)),
    )
    edit = b""
    if skip_ms is not None:
        units = MOVIE_SCALE * 1_000 // MEDIA_SCALE
        rows = ((delay_ms * units // 1000, -1), (total * units // 1000, skip_ms))
        edit = mp4.box(b"edts", _full(b"elst", _words(len(rows)), *(struct.pack(">IiI", length, at, 0x10000) for length, at in rows)))
    english = (5 << 10) | (14 << 5) | 7  # five bits for each letter of "eng"
    mdhd = _full(b"mdhd", _words(0, 0, MEDIA_SCALE, total), struct.pack(">HH", english, 0))
    mdia = mp4.box(b"mdia", mdhd, _full(b"hdlr", _words(0), b"sbtl", b"\0" * 12), mp4.box(b"minf", stbl))
    track = mp4.box(b"trak", mp4.box(b"tkhd", b"\0\0\0\1", _words(0, 0, 7, 0, 0), b"\0" * 60), edit, mdia)
    return top + mp4.box(b"mdat", media) + mp4.box(b"moov", _full(b"mvhd", _words(0, 0, MOVIE_SCALE, 0)), track)


def _films(cues: DataFrame, skip_ms: int | None = None, delay_ms: int = 0) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("cue")
        made = film(table.column("text").to_pylist(), skip_ms, delay_ms)
        return pa.table({"path": [table.column("doc")[0].as_py()], "content": pa.array([made], pa.binary())})

    return cues.groupBy("doc").applyInArrow(build, "path string, content binary")


@query(f"{_CUES} SELECT doc, cue, start_ms, end_ms, text, start_ms * 1000000 AS start_ns, false AS synthetic FROM cues")
def mp4_round_trip(spark, sf):
    """Timed text of a film of every document; empty samples clear the screen."""
    ship(spark)
    return matroska.extract(_films(_cues(spark, sf))).select("doc", "cue", "start_ms", "end_ms", "text", "start_ns", "synthetic")


@query(f"{_CUES} SELECT doc, cue, greatest(start_ms - 250, 500) AS start_ms, end_ms - 250 AS end_ms, text FROM cues")
def mp4_edit_list(spark, sf):
    """750 ms of the beginning are left out, behind an empty edit of 500 ms."""
    ship(spark)
    return matroska.extract(_films(_cues(spark, sf), skip_ms=750, delay_ms=500)).select("doc", "cue", "start_ms", "end_ms", "text")


@query(f"""{_CUES}, s AS (
  SELECT doc, 2 * cue AS k, 2 + octet_length(encode(text)) AS size, start_ms AS dts, 1000 AS duration FROM cues
  UNION ALL SELECT doc, 2 * cue + 1, 2, end_ms, 9000 FROM cues)
SELECT doc, CAST(k AS BIGINT) AS k, CAST(20 + sum(size) OVER (PARTITION BY doc ORDER BY k) - size AS BIGINT) AS at, CAST(size AS BIGINT) AS size, CAST(dts AS BIGINT) AS dts, CAST(duration AS BIGINT) AS duration, CAST(dts AS BIGINT) AS pts, true AS sync FROM s""")
def mp4_sample_table(spark, sf):
    """Place and time of every sample, of text or empty."""
    ship(spark)

    def make(data: bytes) -> list[tuple]:
        rows = mp4.dense_track(mp4.Mp4(data).tracks[0]["stbl"])
        return [(k, *(r[c] for c in ("offset", "size", "dts", "duration", "pts", "sync"))) for k, r in enumerate(rows)]

    schema = "doc string, k long, at long, size long, dts long, duration long, pts long, sync boolean, error string"
    return matroska._table(_films(_cues(spark, sf)), make, schema, "path", "content").filter("error is null").drop("error")


@query(f"""{_CUES} SELECT DISTINCT doc, CASE WHEN CAST(doc AS BIGINT) % 2 = 0 THEN 'mkv' ELSE 'mp4' END AS container, CAST(CASE WHEN CAST(doc AS BIGINT) % 2 = 0 THEN 2 ELSE 7 END AS BIGINT) AS number,
  CASE WHEN CAST(doc AS BIGINT) % 2 = 0 THEN 'S_TEXT/UTF8' ELSE 'tx3g' END AS codec, 'eng' AS language FROM cues""")
def eligible_tracks(spark, sf):
    """Matroska and MP4 files side by side, told apart by their bytes."""
    ship(spark)
    cues, even = _cues(spark, sf), F.col("doc").cast("long") % 2 == 0
    files = _files(cues.filter(even)).unionAll(_films(cues.filter(~even)))
    kinds = folder.sniff(files).select(F.col("path").alias("doc"), "container")
    return matroska.eligible(matroska.probe(files).filter("error is null")).join(kinds, "doc").select("doc", "container", "number", "codec", "language")


#: Palette entries (index, Y, Cr, Cb, alpha): opaque white and opaque black.
_PALETTE = ((1, 235, 128, 128, 255), (2, 16, 128, 128, 255))


def picture(number: int, width: int, height: int, color: int) -> bytes:
    """A display set with one filled rectangle of fewer than 64 columns, or one that clears the screen where color is 0."""
    shown = int(color > 0)
    composition = struct.pack(">HHBHBBBB", 1920, 1080, 0x10, number & 0xFFFF, pgs.EPOCH, 0, 0, shown) + struct.pack(">HBBHH", 0, 0, 0, 10, 20) * shown
    window = b"\1" + struct.pack(">BHHHH", 0, 0, 0, 1920, 1080)
    parts = [(pgs.COMPOSITION, composition), (pgs.WINDOWS, window)]
    if shown:
        code = bytes([0, 0x80 | width, color, 0, 0]) * height
        parts += [(pgs.PALETTE, b"\0\0" + b"".join(map(bytes, _PALETTE))), (pgs.OBJECT, struct.pack(">HBB", 0, 0, 0xC0) + (len(code) + 4).to_bytes(3, "big") + struct.pack(">HH", width, height) + code)]
    return b"".join(pgs.segment(k, b) for k, b in [*parts, (pgs.END, b"")])


def _pictures(cues: DataFrame) -> DataFrame:
    """Two packets for each cue: a rectangle whose size and colour tell of it, and a blank."""
    schema = "doc string, track long, seq long, ts_ns long, data binary"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = 2 * r["cue"]
                rows.append((r["doc"], 1, at, r["start_ms"] * 1_000_000, picture(at, 2 + r["cue"] % 7, 1 + r["n"] % 5, 1 + r["cue"] % 2)))
                rows.append((r["doc"], 1, at + 1, r["end_ms"] * 1_000_000, picture(at + 1, 0, 0, 0)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc", "track", "seq", "ts_ns", "data"])

    return cues.select("doc", "cue", "start_ms", "end_ms", F.octet_length("text").alias("n")).mapInArrow(draw, schema)


@query(f"""{_CUES} SELECT doc, CAST(1 AS BIGINT) AS track, CAST(2 * cue AS BIGINT) AS seq, start_ms, end_ms, false AS synthetic,
  printf('%dx%d ', 2 + cue % 7, 1 + octet_length(encode(text)) % 5) || CASE WHEN cue % 2 = 0 THEN 'ffffffff' ELSE '000000ff' END AS text FROM cues""")
def bitmap_cues(spark, sf):
    """Rectangles drawn, decoded, closed by the next display and read by size and colour."""
    ship(spark)
    return pgs.recognised(pgs.displays(_pictures(_cues(spark, sf))), lambda rgba, w, h: f"{w}x{h} {bytes(rgba[:4]).hex()}")


@query(f"{_CUES} SELECT DISTINCT doc, CASE CAST(doc AS BIGINT) % 3 WHEN 1 THEN 'IncompleteDisplaySet' WHEN 2 THEN 'InvalidTimestamp' END AS error FROM cues")
def bitmap_faults(spark, sf):
    """A third of the tracks lose the end of their last packet, a third run backwards in time; all or nothing."""
    ship(spark)
    packets = _pictures(_cues(spark, sf)).withColumn("last", F.max("seq").over(Window.partitionBy("doc")))
    kind = F.col("doc").cast("long") % 3
    cut = F.when((kind == 1) & (F.col("seq") == F.col("last")), F.expr("substring(data, 1, length(data) - 3)")).otherwise(F.col("data"))
    packets = packets.select("doc", "track", "seq", F.when(kind == 2, -F.col("ts_ns") + 10**15).otherwise(F.col("ts_ns")).alias("ts_ns"), cut.alias("data"))
    return pgs.displays(packets).select("doc", "error").distinct()


def _listing(spark: SparkSession, sf: str, name: str, attributes) -> str:
    """Pages of ten nations in JSON, a file each; returns their path."""
    rows = spark.read.parquet(f"{sf}/nation.parquet")
    total = rows.agg(F.count("*").cast("int").alias("total_count"), F.ceil(F.count("*") / 10).cast("int").alias("total_pages"))
    page = F.floor(F.col("n_nationkey") / 10).cast("int") + 1
    entry = F.struct(F.col("n_nationkey"), F.col("n_nationkey").cast("string").alias("id"), attributes.alias("attributes"))
    pages = rows.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    data = F.transform("rows", lambda r: F.struct(r["id"].alias("id"), r["attributes"].alias("attributes")))
    path = fresh_path(spark, name)
    pages.crossJoin(total).select(F.to_json(F.struct("page", "total_pages", "total_count", data.alias("data"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # total is one row
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title, 'Tvshow' AS feature_type, CAST(n_nationkey AS VARCHAR) AS feature_id, CAST(n_nationkey + 100 AS BIGINT) AS imdb_id, CAST(1950 + n_nationkey AS VARCHAR) AS year, false AS truncated FROM nation")
def catalog_shows(spark, sf):
    """A listing of several pages that agree with their totals."""
    key = F.col("n_nationkey")
    attributes = F.struct(F.col("n_name").alias("title"), F.lit("Tvshow").alias("feature_type"), key.cast("string").alias("feature_id"), (key + 100).alias("imdb_id"), (key + 1950).cast("string").alias("year"))
    return catalog.shows(spark, _listing(spark, sf, "shows", attributes))


@query("""WITH s AS (
  SELECT n_nationkey AS k, n_regionkey AS season, CAST(n_nationkey AS VARCHAR) AS subtitle_id FROM nation
  WHERE n_nationkey % 5 <> 4 AND n_nationkey % 11 <> 0 AND n_nationkey % 6 <> 1)
SELECT season, subtitle_id, CAST(k * 10 AS BIGINT) AS file_id, CAST(row_number() OVER (PARTITION BY season ORDER BY CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, k * 37 % 10 DESC, subtitle_id) AS INTEGER) AS place FROM s""")
def subtitle_order(spark, sf):
    """Which subtitles may be used, and in what order; open flags and second files rule one out."""
    key = F.col("n_nationkey")
    file = F.struct((key * 10).cast("long").alias("file_id"), F.lit(1).alias("cd_number"), F.concat(F.col("n_name"), F.lit(".srt")).alias("file_name"))
    attributes = F.struct(
        key.cast("string").alias("subtitle_id"), F.lit("en").alias("language"), F.struct(F.col("n_regionkey").alias("season_number"), key.alias("episode_number")).alias("feature_details"),
        (key % 5 == 4).alias("foreign_parts_only"), F.lit(False).alias("ai_translated"), F.when(key % 11 != 0, False).alias("machine_translated"), (key % 3 == 0).alias("hearing_impaired"),
        (key % 4 == 0).alias("from_trusted"), (key * 37 % 10).alias("download_count"), F.when(key % 6 == 1, F.array(file, file)).otherwise(F.array(file)).alias("files"),
    )
    rows = catalog.unfit(catalog.subtitles(spark, _listing(spark, sf, "subtitles", attributes))).filter("not skip")
    return rows.select(F.col("season_number").alias("season"), "subtitle_id", "file_id", F.row_number().over(Window.partitionBy("season_number").orderBy(*catalog.rank_order())).alias("place"))


@query("""WITH e AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS episode FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS show, 1 AS season, CAST(episode AS INTEGER) AS episode, CAST(n_nationkey AS BIGINT) AS feature_id, n_name AS title FROM e WHERE episode BETWEEN 2 AND 4""")
def season_episodes(spark, sf):
    """The second to the fourth episode of each region's first season."""
    order = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_regionkey", F.struct(order.alias("episode_number"), F.col("n_nationkey").alias("feature_id"), F.col("n_name").alias("title")).alias("e"))
    seasons = lambda episodes: F.array(F.struct(F.lit(1).alias("season_number"), episodes.alias("episodes")), F.struct(F.lit(2).alias("season_number"), F.slice(episodes, 1, 1).alias("episodes")))
    shows = rows.groupBy("n_regionkey").agg(F.collect_list("e").alias("e"))
    data = F.array(F.struct(F.col("n_regionkey").cast("string").alias("id"), F.struct(seasons(F.col("e")).alias("seasons")).alias("attributes")))
    path = fresh_path(spark, "seasons")
    shows.select(F.to_json(F.struct(data.alias("data"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return catalog.episodes(spark, path, 1, 2, 4)


@query("SELECT CAST(n_nationkey AS BIGINT) AS show_id, n_name || ' (' || CAST(1950 + n_nationkey AS VARCHAR) || ')' AS prefix FROM nation WHERE n_nationkey = 7")
def series_prefix(spark, sf):
    """How the one show asked for is written in file names."""
    key = F.col("n_nationkey")
    attributes = F.struct(F.lit("TV Show").alias("feature_type"), key.cast("string").alias("feature_id"), F.col("n_name").alias("original_title"), (key + 100).alias("imdb_id"), (key + 1950).cast("string").alias("year"))
    row = spark.read.parquet(f"{sf}/nation.parquet").filter(key == 7)  # the show asked for
    path = fresh_path(spark, "series")
    row.select(F.to_json(F.struct(F.array(F.struct(key.cast("string").alias("id"), attributes.alias("attributes"))).alias("data"))).alias("value")).write.text(path)
    return catalog.display_prefix(catalog.series_display(spark, path, 7, 107))


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS nations FROM nation GROUP BY ALL")
def frozen_selection(spark, sf):
    """K1-K4: rows frozen under the digest of their scope; freezing them again changes nothing, and the ledger counts its steps."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"))
    where = fresh_path(spark, "frozen")
    path = sinks.freeze(rows, where, {"by": "region"})
    if sinks.freeze(rows, where, {"by": "region"}) != path:
        raise RuntimeError("the same selection was stored twice")
    ledger = fresh_path(spark, "ledger")
    for step in (1, 2, 3):
        sinks.append_step(spark, ledger, {"step": step})
    return sinks.published(spark, path)[0]
