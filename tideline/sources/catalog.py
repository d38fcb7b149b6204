"""Catalog answers in JSON, stored as files: pages of shows, seasons and subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_name

ENVELOPE = "page int, total_pages int, total_count int"
SHOWS = f"{ENVELOPE}, data array<struct<id:string,attributes:struct<title:string,feature_type:string,feature_id:string,imdb_id:long,year:string>>>"
SEASONS = "data array<struct<id:string,attributes:struct<title:string,seasons:array<struct<season_number:int,episodes:array<struct<episode_number:int,feature_id:long,title:string>>>>>>>"
SUBTITLES = f"{ENVELOPE}, data array<struct<id:string,attributes:struct<subtitle_id:string,language:string,feature_details:struct<feature_id:long,season_number:int,episode_number:int,title:string>,foreign_parts_only:boolean,ai_translated:boolean,machine_translated:boolean,hearing_impaired:boolean,from_trusted:boolean,download_count:long,release:string,comments:string,uploader:struct<name:string>,files:array<struct<file_id:long,cd_number:int,file_name:string>>>>>"
DISPLAY = "total_pages int, data array<struct<id:string,attributes:struct<feature_type:string,feature_id:string,original_title:string,imdb_id:long,year:string>>>"
MOST_PAGES = 10
MOST_ROWS = 1000


class CatalogError(ValueError):
    """A stored answer that contradicts itself or what was asked for."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def _pages(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    """Rows of a listing in page order, every id once, with truncated: did the listing hold more?

    Pages count from 1 without gaps and agree on their totals, and only the last may be
    empty; a lone page may come without any. At most MOST_PAGES pages and MOST_ROWS rows
    are taken. With `whole`, a listing that is cut or lacks totals raises. Null ids are
    one id; null data is an empty page.
    """
    pages = _read(spark, path, schema)
    size = F.coalesce(F.size("data"), F.lit(0))
    got = pages.agg(
        F.count("*").alias("n"), F.count_distinct(F.struct("total_pages", "total_count")).alias("kinds"), F.max("total_pages").alias("pages"), F.max("total_count").alias("total"),
        F.min("page").alias("first"), F.max("page").alias("last"), F.count_distinct("page").alias("numbers"), F.sum(size).alias("rows"),
        F.coalesce(F.max(F.when(size == 0, F.col("page"))), F.lit(0)).alias("bare"),
    ).first()
    if got.n == 0:
        raise CatalogError(f"{path}: no page")
    wanted = min(got.pages or 1, MOST_PAGES)
    full = got.n == wanted or (got.n < wanted and got.rows >= MOST_ROWS)
    counted = (got.first, got.last, got.numbers) == (1, got.n, got.n) or (got.n == wanted == 1 and got.last is None)
    if got.kinds != 1 or not full or not counted or (got.total is not None and got.rows > got.total) or (got.pages == 0 and (got.rows or got.total)) or 0 < got.bare < wanted:
        raise CatalogError(f"{path}: pages do not agree with their totals")
    truncated = (got.pages or 0) > got.n or got.rows > MOST_ROWS or got.rows < (got.total or 0) or (got.pages is None and got.last is not None)
    if whole and (truncated or None in (got.pages, got.total, got.last)):
        raise CatalogError(f"{path}: the listing is cut or does not say that it is whole")
    rows = pages.select("page", F.posexplode("data").alias("place", "d"))
    if got.rows > MOST_ROWS:
        rows = rows.orderBy("page", "place").limit(MOST_ROWS)
    rows = rows.select("d.id", "d.attributes.*", F.lit(truncated).alias("truncated"))
    if rows.groupBy("id").count().filter("count > 1").head():
        raise CatalogError(f"{path}: an id occurs twice")
    return rows


def shows(spark: SparkSession, path: str) -> DataFrame:
    """id, title, feature_type, feature_id, imdb_id, year, truncated of shows with a valid title.

    Where truncated is true, the listing held more: a lone match proves nothing then.
    """
    return _pages(spark, path, SHOWS, whole=False).filter(clean_name(F.col("title")))


def series_display(spark: SparkSession, path: str, show_id: int, imdb_id: int | None = None) -> DataFrame:
    """One row show_id, original_title, year, imdb_id: how a show is written in file names.

    The answer must hold one show alone, the one asked for, with a year of four digits; an
    empty title is null. Anything else raises, a null or an absent row too.
    """
    found = _read(spark, path, DISPLAY)
    rows = found.select("total_pages", F.explode("data").alias("d")).select("total_pages", "d.attributes.*").limit(2).collect()
    if len(rows) != 1 or rows[0].total_pages not in (None, 1):
        raise CatalogError(f"{path}: not one show")
    row = found.select(F.explode("data").alias("d")).select("d.attributes.*")
    title = F.nullif("original_title", F.lit(""))
    kind = F.lower("feature_type").isin("tvshow", "tv show")
    same = F.lit(True) if imdb_id is None else F.col("imdb_id").eqNullSafe(F.lit(imdb_id).cast("long"))
    number = lambda c: F.col(c).rlike("^[1-9][0-9]{0,9}$") & (F.expr(f"try_cast({c} AS bigint)") <= 0x7FFFFFFF)
    imdb = F.col("imdb_id").isNull() | F.col("imdb_id").between(1, 0x7FFFFFFF)
    sound = kind & number("feature_id") & (F.col("feature_id") == str(show_id)) & imdb & same & F.col("year").rlike("^[1-9][0-9]{3}$") & (title.isNull() | clean_name(title, 200))
    row = row.select(F.expr("try_cast(feature_id AS bigint)").alias("show_id"), title.alias("original_title"), F.expr("try_cast(year AS int)").alias("year"), "imdb_id", F.coalesce(sound, F.lit(False)).alias("sound"))
    if row.filter("sound").isEmpty():
        raise CatalogError(f"{path}: not the show asked for, or its display data are invalid")
    return row.drop("sound")


def display_prefix(display: DataFrame, name: str | None = None) -> DataFrame:
    """show_id, prefix "title (year)"; `name` stands in for the title, and without either it is null."""
    title = F.lit(name).cast("string") if name is not None else F.col("original_title")
    return display.select("show_id", F.concat(title, F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("prefix"))


def episodes(spark: SparkSession, path: str, season: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """show, season, episode, feature_id, title of one season, and of a range of it."""
    rows = _read(spark, path, SEASONS)
    rows = rows.select(F.explode("data").alias("d")).select(F.col("d.id").alias("show"), F.explode("d.attributes.seasons").alias("s"))
    rows = rows.filter(F.col("s.season_number") == season).select("show", F.col("s.season_number").alias("season"), F.explode("s.episodes").alias("e"))
    rows = rows.select("show", "season", F.col("e.episode_number").alias("episode"), "e.feature_id", "e.title").dropDuplicates()
    return rows if low is None else rows.filter(F.col("episode").between(low, high))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each subtitle, its first file beside it and the number of its files.

    A listing that is cut, or whose rows are fewer than its total, raises.
    """
    rows = _pages(spark, path, SUBTITLES, whole=True)
    first = F.try_element_at("files", F.lit(1))
    return rows.select("id", "subtitle_id", "language", "feature_details.*", "foreign_parts_only", "ai_translated", "machine_translated", "hearing_impaired", "from_trusted", "download_count", "release", "comments", F.col("uploader.name").alias("uploader"), F.size("files").alias("n_files"), first["file_id"].alias("file_id"), first["cd_number"].alias("cd_number"), first["file_name"].alias("file_name"))


def rank_order() -> list:
    """Trusted first, then without hearing aids, then the most downloaded; ids settle ties."""
    return [~F.coalesce("from_trusted", F.lit(False)), F.coalesce("hearing_impaired", F.lit(False)), F.desc("download_count"), F.col("subtitle_id"), F.col("file_id")]


def unfit(rows: DataFrame) -> DataFrame:
    """rows with skip: translated by machine, foreign parts alone, several files or a second disc, or flags left open."""
    flags = ("foreign_parts_only", "ai_translated", "machine_translated")
    skip = F.lit(False)
    for f in flags:
        skip |= F.coalesce(f, F.lit(True))
    return rows.withColumn("skip", skip | (F.col("n_files") != 1) | (F.coalesce("cd_number", F.lit(1)) != 1))
