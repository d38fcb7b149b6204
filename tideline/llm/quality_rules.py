"""Quality rules with thresholds that adapt to each language and source.

Method: five metrics of each text go into mergeable quantile sketches, one for each
(language, source, metric). A sketch is a histogram over buckets that keep a value's
six leading bits, so a quantile is off by 1/32 of its value at most; sketches merge by adding counts, which is how
those of a language and of the whole table come from those of its sources. A limit lies beyond a
tail quantile of the group by `REACH` times that quantile's distance from the median, and by
the sketch's own error; nothing else enters it. The quantiles of a group of n
texts are averaged with those of its parent (its language, the whole table), which
count as `PRIOR` texts, so small groups follow their parents. The table of limits is joined
to the rows to filter them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._counts import base_counts
from ._spark import stored
from ._text import Words, chunks

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

#: Metric: (numerator, denominator) in thousandths, and its tails in hundredths: the share of texts
#: beyond either tail quantile. Few texts have many symbols, and in some groups those are junk;
#: repeated lines and words are rare and harmless in most groups.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 20),
    "upper": ("n_upper", "word_chars", 10),
    "word_length": ("word_chars", "n_words", 10),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 1),
}

#: A limit lies so many times the distance from the median to the tail quantile beyond that quantile.
REACH = 3
#: A parent's quantiles count as so many texts of the group.
PRIOR = 50
SIDES = ("low", "mid", "high")


def count_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(3)):
                rows, found = batch.slice(row, len(offsets) - 1), base_counts(Words(data, offsets))
                yield pa.record_batch([*rows.columns[:3], *rows.columns[4:], *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["id", "lang", "source", *carry, *COUNTS])

    texts = docs.select(*(F.col(c).cast(t).alias(n) for c, t, n in ((id_col, "long", "id"), (lang_col, "string", "lang"), (source_col, "string", "source"), (text_col, "string", "text"))), *carry)
    carried = "".join(f"`{c}` {t}, " for c, t in texts.dtypes[4:])
    return texts.mapInArrow(count, f"id long, lang string, source string, {carried}" + ", ".join(f"{c} long" for c in COUNTS))


def _metric(name: str):
    over, under, _ = METRICS[name]
    return F.expr(f"1000 * {over} div greatest({under}, 1)")


def _bucket(value):
    """value with all but its six leading bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one sketch for each group and metric; add n to merge."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _bucket(_metric(m)).alias("bucket")) for m in METRICS)))
    return counts.select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))


def _tail(metric):
    return F.element_at(F.create_map(*(F.lit(x) for m, (_, _, tail) in METRICS.items() for x in (m, tail))), metric)


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, its low, mid and high quantile and the total of the sketches merged by keys."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.select(*keys, "metric", "bucket", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"), _tail(F.col("metric")).alias("tail"))
    at = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(at(F.col("tail")).alias("low"), at(F.lit(50)).alias("mid"), at(100 - F.col("tail")).alias("high"), F.max("total").alias("total"))


def shrunk(own: DataFrame, parent: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """own with its quantiles averaged with those of parent, which has keys, metric and quantiles."""
    above = parent.select(*(F.col(k).alias(f"p_{k}") for k in keys), F.col("metric").alias("p_metric"), *(F.col(c).alias(f"p_{c}") for c in SIDES))
    same = F.col("metric") == F.col("p_metric")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"p_{k}"))
    mean = lambda c: F.expr(f"(total * {c} + {prior} * p_{c}) div (total + {prior})").alias(c)
    return own.join(above, same).select(*(c for c in own.columns if c not in SIDES), *map(mean, SIDES))


def limits(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and, for each metric, the limits lo_ and hi_."""
    whole = quantiles(sketch, [])
    langs = shrunk(quantiles(sketch, ["lang"]), whole, [], prior)
    own = shrunk(quantiles(sketch, ["lang", "source"]), langs, ["lang"], prior)
    low, high = F.expr(f"low - {REACH} * (mid - low) - low div 32"), F.expr(f"high + {REACH} * (high - mid) + high div 32")
    fences = own.select("lang", "source", "metric", low.alias("lo"), high.alias("hi"))
    return fences.groupBy("lang", "source").agg(*(F.min(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("lo", "hi")))


def quality_rules(docs: DataFrame, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict of every row: id_col, the counts, base_failed, kept, and the columns of carry (of other names).

    base_failed: under 20 words, or over 30 in 100 words in repeated 8-word windows.
    kept: base passed, and every metric lies within its group's limits, which come
    from all rows that pass base. Null and empty texts have no words and fail base.
    Null languages and sources form groups of their own. Rows that repeat, ids that
    repeat or are null: each row is judged by itself and returned once. Extra columns
    are ignored. An empty table gives an empty result.
    """
    counts = count_texts(docs, id_col, text_col, lang_col, source_col, carry)
    counts = stored(counts.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")), "counts")
    fences = limits(stored(sketches(counts.filter("not base_failed")), "sketches"), prior)
    fences = fences.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    judged = counts.join(fences, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = F.lit(True)
    for m in METRICS:
        within &= _metric(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), *carry)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base_failed and kept of every row of documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    metric = {m: f"(1000 * {a}) // greatest({b}, 1)" for m, (a, b, _) in METRICS.items()}
    fences = ", ".join(f"min(low - {REACH} * (mid - low) - low // 32) FILTER (metric = '{m}') AS lo_{m}, min(high + {REACH} * (high - mid) + high // 32) FILTER (metric = '{m}') AS hi_{m}" for m in METRICS)
    within = " AND ".join(f"{v} BETWEEN lo_{m} AND hi_{m}" for m, v in metric.items())
    tails = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, (_, _, t) in METRICS.items()) + " END"
    quant = lambda keys: f"""SELECT {keys} metric, min(bucket) FILTER (upto * 100 >= total * tail) AS low, min(bucket) FILTER (upto * 2 >= total) AS mid,
             min(bucket) FILTER (upto * 100 >= total * (100 - tail)) AS high, CAST(max(total) AS BIGINT) AS total FROM (
      SELECT {keys} metric, bucket, {tails} AS tail, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} metric) AS total
      FROM (SELECT {keys} metric, bucket, sum(n) AS n FROM sketch GROUP BY {keys} metric, bucket)) GROUP BY {keys} metric"""  # noqa: E731
    mean = ", ".join(f"(o.total * o.{c} + {PRIOR} * p.{c}) // (o.total + {PRIOR}) AS {c}" for c in SIDES)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t
), win AS (
  SELECT rid, p, array_to_string(list_slice(ws, p, p + 7), ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)
), many AS (
  SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(p, p + 8)) AS q FROM win JOIN many USING (rid, g)) GROUP BY rid
), c AS (
  SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), m AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM b WHERE NOT base_failed" for k, v in metric.items())}
), sketch AS (
  SELECT lang, source, metric, (v >> low) << low AS bucket, count(*) AS n
  FROM (SELECT *, CAST(greatest(length(bin(v)) - 6, 0) AS INTEGER) AS low FROM m) GROUP BY ALL
), whole AS ({quant("")}), lang_q AS ({quant("lang,")}), own_q AS ({quant("lang, source,")}),
langs AS (SELECT o.lang, o.metric, {mean} FROM lang_q o JOIN whole p ON o.metric = p.metric),
own AS (SELECT o.lang, o.source, o.metric, {mean} FROM own_q o JOIN langs p ON o.metric = p.metric AND o.lang IS NOT DISTINCT FROM p.lang),
f AS (SELECT lang, source, {fences} FROM own GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, base_failed,
       NOT base_failed AND coalesce({within}, false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


ORACLE_SQL = _oracle()
