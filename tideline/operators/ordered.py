"""Computations over ordered neighbours, as-of lookups and container sample tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: Sequence[str], order: Sequence[str | Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def regressions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, strict: bool = False) -> DataFrame:
    """Rows whose value falls behind the one before (or only equals it, if strict)."""
    before = F.lag(value).over(_w(keys, order))
    return rows.filter(F.lit(True)).withColumn("before", before).filter((F.col(value) <= F.col("before")) if strict else (F.col(value) < F.col("before")))


def closed_intervals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, state: Sequence[str]) -> DataFrame:
    """Rows whose state differs from the one before, each ended by the next of them; the last stays open."""
    w = _w(keys, order)
    same = F.lit(True)
    for s in state:
        same &= F.lag(s).over(w).eqNullSafe(F.col(s))
    kept = rows.withColumn("unchanged", same & (F.row_number().over(w) > 1)).filter(~F.col("unchanged")).drop("unchanged")
    return kept.withColumn("end_ts", F.lead(ts).over(w))


def overlaps(rows: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows that start before an earlier one of their key has ended."""
    w = _w(keys, [start, tie])
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("busy_until", before).filter(F.col("busy_until") > F.col(start))


def running_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))


def fifo_eviction(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, cap: Column) -> DataFrame:
    """The oldest rows that must go so that what is left fits: those before which too little has gone."""
    total = F.sum(size).over(Window.partitionBy(*keys))
    return running_before(rows, keys, order, size).withColumn("excess", total - cap).filter(F.col("before") < F.col("excess"))


def renumbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(_w(keys, order)))


def moved(rows: DataFrame, keys: Sequence[str], by: str, ordinal: str) -> DataFrame:
    """keys, n_moved: rows that a stable sort by `by` puts elsewhere."""
    at = rows.withColumn("was", F.row_number().over(_w(keys, [ordinal]))).withColumn("now", F.row_number().over(_w(keys, [by, ordinal])))
    return at.groupBy(*keys).agg(F.count_if(F.col("was") != F.col("now")).alias("n_moved"))


def checkpoints(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: Sequence[int] = (64, 128, 192)) -> DataFrame:
    """Each row once for every checkpoint whose prefix holds it."""
    numbered = renumbered(rows, keys, order, "position")
    return numbered.withColumn("checkpoint", F.explode(F.array(*map(F.lit, at)))).filter("position <= checkpoint")


def resetting_windows(rows: DataFrame, key: str, ts: str, length: int, cut: str | None = None) -> DataFrame:
    """key, ts, window: a new window starts when one has lasted `length`, or at a row flagged by cut.

    The start resets at every cut, so no fixed grid says it; each key is folded in order, a
    batch at a time, and only the state of the current window is kept.
    """
    flag = F.col(cut).cast("boolean") if cut else F.lit(False)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(key).cast("long").alias("k"), F.col(ts).cast("long").alias("t"), F.coalesce(flag, F.lit(False)).alias("c"))
    dealt = dealt.repartition(partitions, "k").sortWithinPartitions("k", "t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start, number = None, 0, 0
        for batch in batches:
            windows = np.empty(len(batch), np.int64)
            k, t, c = (batch.column(i).to_pylist() for i in range(3))
            for i in range(len(batch)):
                if k[i] != current:
                    current, start, number = k[i], t[i], 0
                elif c[i] or t[i] - start >= length:
                    start, number = t[i], number + 1
                windows[i] = number
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(windows)], ["k", "t", "window"])

    return dealt.mapInArrow(fold, "k long, t long, window long").toDF(key, ts, "window")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ts: str, tie: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before `at`; equal times: the largest tie.

    A union ordered by time, so each side is shuffled once and nothing is multiplied.
    """
    nothing = lambda c, t: F.lit(None).cast(t).alias(c)
    types = dict(right.dtypes)
    a = left.select("*", F.col(at).alias("__t"), F.lit(1).alias("__side"), nothing("__tie", types[tie]), nothing("__value", f"struct<v:{types[value]}>"))
    pad = [F.col(c) if c in keys else nothing(c, t) for c, t in left.dtypes]
    b = right.select(*pad, F.col(ts).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(F.col(value).alias("v")).alias("__value"))
    w = _w(keys, ["__t", "__side", "__tie"]).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__last", F.last("__value", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select(*left.columns, F.col("__last.v").alias(value))


def keyframe_at(samples: DataFrame, keys: Sequence[str], pts: str, sync: str, at: Column) -> DataFrame:
    """keys, sample_pts: the last sync sample at or before a time, else the first one after it."""
    sure = samples.filter(F.col(sync))
    before, after = F.max(F.when(F.col(pts) <= at, F.col(pts))), F.min(F.when(F.col(pts) > at, F.col(pts)))
    return sure.groupBy(*keys).agg(F.coalesce(before, after).alias("sample_pts"))


def expand_runs(runs: DataFrame, keys: Sequence[str], order: str, count: str, value: str) -> DataFrame:
    """keys, sample (from 0), value: run-length pairs written out."""
    first = running_before(runs, keys, [order], count)
    each = F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))
    out = first.select(*keys, F.col("before").cast("long").alias("before"), F.col(value), each.alias("i"))
    return out.select(*keys, (F.col("before") + F.col("i")).alias("sample"), value)


def decode_times(samples: DataFrame, keys: Sequence[str], duration: str) -> DataFrame:
    return running_before(samples, keys, ["sample"], duration).withColumnRenamed("before", "dts")


def chunk_offsets(chunks: DataFrame, runs: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sample, offset, size.

    chunks: keys, chunk (from 1), offset. runs: keys, first_chunk, per_chunk; a run lasts until
    the next begins. sizes: keys, sample (from 0), size. Chunks beyond the samples are ignored.
    """
    held = as_of(chunks, runs.withColumn("tie", F.col("first_chunk")), keys, "chunk", "first_chunk", "tie", "per_chunk")
    first = running_before(held, keys, ["chunk"], "per_chunk").withColumn("i", F.explode(F.when(F.col("per_chunk") > 0, F.sequence(F.lit(0), F.col("per_chunk").cast("int") - 1))))
    placed = first.select(*keys, "chunk", F.col("offset").alias("base"), (F.col("before") + F.col("i")).cast("long").alias("sample"))
    sized = placed.join(sizes, [*keys, "sample"])
    w = _w([*keys, "chunk"], ["sample"]).rowsBetween(Window.unboundedPreceding, -1)
    return sized.select(*keys, "sample", (F.col("base") + F.coalesce(F.sum("size").over(w), F.lit(0))).cast("long").alias("offset"), "size")


def sync_flags(samples: DataFrame, sync: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """samples with sync: all of them without a sync table, else those it lists, counted from 1."""
    if sync is None:
        return samples.withColumn("sync", F.lit(True))
    listed = sync.select(*keys, (F.col("number") - 1).cast("long").alias("sample"), F.lit(True).alias("listed")).dropDuplicates()
    return samples.join(listed, [*keys, "sample"], "left").withColumn("sync", F.coalesce("listed", F.lit(False))).drop("listed")


def presentation_times(samples: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """samples with pts = dts + offset, not below 0; a missing offset counts as 0."""
    joined = samples.join(offsets.select(*keys, "sample", F.col("offset").alias("shift")), [*keys, "sample"], "left")
    return joined.withColumn("pts", F.greatest(F.col("dts") + F.coalesce("shift", F.lit(0)), F.lit(0)).cast("long")).drop("shift")


def contained(extents: DataFrame, boxes: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """keys, item, inside: does every extent [start, start + length) of an item lie in a box of its key?"""
    b = boxes.select(*keys, F.col("box_start"), F.col("box_end"))
    held = extents.join(b, list(keys), "left")
    per = held.groupBy(*keys, item, "start", "length").agg(F.bool_or((F.col("start") >= F.col("box_start")) & (F.col("start") + F.col("length") <= F.col("box_end"))).alias("inside"))
    return per.groupBy(*keys, item).agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("inside"))


def properties_of(associations: DataFrame, properties: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """keys, item, properties in association order.

    associations: keys, item, indexes (array, counted from 1); 0 and numbers beyond the table are skipped.
    """
    each = associations.select(*keys, item, F.posexplode("indexes").alias("position", "number"))
    named = each.join(properties.select(*keys, "number", "property"), [*keys, "number"])
    per = named.groupBy(*keys, item).agg(F.array_sort(F.collect_list(F.struct("position", "property"))).alias("p"))
    return per.select(*keys, item, F.col("p.property").alias("properties"))


def track_settings(tracks: DataFrame) -> DataFrame:
    """Declared track flags with their defaults, and the language that holds."""
    return tracks.select("track", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("is_default", F.lit(True)).alias("is_default"), F.coalesce("forced", F.lit(False)).alias("forced"), F.coalesce("ietf", "language", F.lit("eng")).alias("language"))


def cue_points(points: DataFrame, scale: Column) -> DataFrame:
    """One row for each time and track position, in ns; a product beyond 64 bits is null."""
    each = points.select("time", F.explode("positions").alias("p"))
    return each.select(F.try_multiply("time", scale).alias("ts_ns"), "p.track", "p.position")
