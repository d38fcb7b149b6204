"""Identify the videos of a folder against reference transcripts and rename them.

    python -m tideline --folder VIDEOS --references SRTS --show NAME --season N [--episodes A-B] [--dry-run]

References are files named `SnnEnn Title.srt`. Exit codes: 0 all identified, 1 failures or
conflicts, 2 something unknown, 3 something ambiguous.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import code_label, collision_key, file_name, parse_label, safe_component
from .limits import EPISODE_PAIRS, LIMITS
from .operators import plan
from .operators.matching import Index
from .paths import resolve
from .shipping import ship
from .sources import folder, matroska, srt


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tideline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, allow_abbrev=False)
    parser.add_argument("--folder", default=".")
    parser.add_argument("--references", required=True)
    parser.add_argument("--show", required=True)
    parser.add_argument("--season", required=True)
    parser.add_argument("--episodes")
    parser.add_argument("--dry-run", action="store_true")
    out = parser.parse_args(argv)

    def number(text: str, most: int) -> int:
        if not (text.isascii() and text.isdigit() and len(text) <= 9 and 1 <= int(text) <= most):
            parser.error(f"expected a number from 1 to {most}: {text}")
        return int(text)

    out.season = number(out.season, 100)
    low, _, high = (out.episodes or "").partition("-")
    out.episodes = None if out.episodes is None else (number(low, 1000), number(high or low, 1000))
    if out.episodes and out.episodes[0] > out.episodes[1]:
        parser.error("the episode range must ascend")
    if not 3 <= len(out.show.encode()) <= 200 or out.show.strip() != out.show or not out.show.isprintable():
        parser.error("--show takes 3 to 200 bytes of plain text")
    return out


def references(spark: SparkSession, path: str, season: int, episodes: tuple[int, int] | None) -> DataFrame:
    """Cues of the season's reference files; a file that cannot be read is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").load(path)
    name = F.regexp_replace(F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B"))), r"\.srt$", "")
    files = files.select(name.alias("label"), "content").withColumn("p", parse_label(F.col("label"))).filter(F.col("p.season") == season)
    if episodes:
        files = files.filter(F.col("p.episode").between(*episodes))
    rows = srt.read_srt(files, "label")
    if broken := rows.filter("error is not null").head():
        raise ValueError(f"{broken.doc}: line {broken.line}: {broken.error}")
    return rows


def scan(spark: SparkSession, path: str, index: Index) -> DataFrame:
    """(file, outcome, ref): each file's first track that is identified, else what its tracks say."""
    files = folder.media_files(spark, path)
    tracks = matroska.probe(files)
    wanted = matroska.eligible(tracks.filter("error is null and supported")).select("doc", "number")
    each = []
    for n in [r.number for r in wanted.select("number").distinct().orderBy("number").limit(64).collect()]:
        held = files.join(wanted.filter(F.col("number") == n).select(F.col("doc").alias("path")), "path", "left_semi")
        cues = matroska.extract(held, n).filter("error is null").select("doc", "cue", "start_ms", "text")
        each.append(index.match(cues, EPISODE_PAIRS).select(F.col("doc").alias("file"), F.lit(n).alias("track"), "outcome", F.col("best.ref").alias("ref")))
    found = files.select(F.col("path").alias("file"))
    if not each:
        return found.select("file", F.lit("Error").alias("outcome"), F.lit(None).cast("string").alias("ref"))
    results = each[0]
    for more in each[1:]:
        results = results.unionAll(more)
    best = plan.precedence(results, "file", "track", "outcome").join(results, ["file", "track", "outcome"])
    return found.join(best, "file", "left").select("file", F.coalesce("outcome", F.lit("Error")).alias("outcome"), F.when(F.col("outcome") == "Identified", F.col("ref")).alias("ref"))


def planned(scans: DataFrame, show: str) -> DataFrame:
    """(source, target, outcome, state): collisions and targets held by files that stay are conflicts."""
    source = F.url_decode(F.replace(F.substring_index("file", "/", -1), F.lit("+"), F.lit("%2B")))
    p = parse_label(F.col("ref"))
    code = F.substring_index(code_label(p["season"], p["episode"], F.lit("")), " ", 1)
    target = F.when(F.col("ref").isNotNull(), file_name(safe_component(F.lit(show)), code, safe_component(p["title"]), F.lower(F.substring_index(source, ".", -1))))
    rows = scans.select(source.alias("source"), target.alias("target"), "outcome")
    twice = (F.count("target").over(Window.partitionBy(collision_key(F.col("target")))) > 1) & F.col("target").isNotNull()
    stays = F.when(F.col("outcome") == "Error", "Failed").when(F.col("outcome") != "Identified", F.col("outcome")).when(twice, "Conflict").when(F.col("source") == F.col("target"), "AlreadyCorrect").otherwise("Planned")
    rows = rows.withColumn("state", stays)
    held = plan.occupants(rows, rows.select(F.col("source").alias("place"))).filter("holders < 2 or target is null or state <> 'Planned'")
    waits = held.select(F.col("source").alias("row"), F.when(F.col("occupant") != F.col("source"), F.col("occupant")).alias("waits_for"), "state")
    return plan.blocked(waits).select(F.col("row").alias("source"), "state").join(rows.drop("state"), "source").select("source", "target", "outcome", "state")


def main(argv: list[str] | None = None) -> int:
    options = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    ship(spark)
    try:
        where = str(resolve(options.folder))
        cues = references(spark, str(resolve(options.references)), options.season, options.episodes)
        index = Index.build(cues.select("doc", "cue", "start_ms", "text"), LIMITS.references_most)
        rows = sorted(planned(scan(spark, where, index), options.show).collect())
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    marks = {"Planned": "->", "AlreadyCorrect": "already correct", "Conflict": "conflict", "Failed": "scan failed", "Unknown": "unidentified", "Ambiguous": "ambiguous"}
    for r in rows:
        print(f"{r.source}: {marks[r.state]}" + (f" {r.target}" if r.state == "Planned" else ""))
    if options.episodes:
        seen = {r.target.split(" - ")[1] for r in rows if r.target}
        missing = [e for e in range(options.episodes[0], options.episodes[1] + 1) if f"S{options.season:02}E{e:02}" not in seen]
        print("missing episodes: " + (", ".join(map(str, missing)) or "none"))
    moves = [(os.path.join(where, r.source), os.path.join(where, r.target)) for r in rows if r.state == "Planned"]
    if moves and not options.dry_run and input(f"Rename {len(moves)} files? [y/N] ").strip().lower() == "y":
        print(f"renamed {len(plan.apply_moves(moves))} files")
    states = {r.state for r in rows}
    return 1 if states & {"Failed", "Conflict"} else 3 if "Ambiguous" in states else 2 if "Unknown" in states else 0
