"""Catalog, window, container and plan operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions import timecode as t
from ..operators import catalog, ledger, ordered, plan
from ..shipping import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: (l_orderkey, l_linenumber) repeats in lineitem; this is one row for each.
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return per.agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")))


# --- catalog -----------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderpriority, o_totalprice DESC, o_orderkey) = 1""")
def rank_first_per_key(spark, sf):
    """The best variant of each key."""
    o = table(spark, sf, "orders")
    return catalog.first_per_key(o, ["o_custkey"], [F.col("o_orderstatus") != "F", F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def coverage_anti(spark, sf):
    """What is expected and not found: customers without an urgent order."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""WITH e AS (SELECT n_nationkey, n_name, [n_nationkey, n_nationkey + 100] AS ids FROM nation), f AS (SELECT DISTINCT s_nationkey AS id FROM supplier WHERE s_acctbal > 8000)
SELECT n_nationkey, n_name FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE list_contains(e.ids, f.id))""")
def coverage_any_of(spark, sf):
    """Expected rows none of whose ids were found."""
    e = table(spark, sf, "nation").select("n_nationkey", "n_name", F.array(F.col("n_nationkey"), F.col("n_nationkey") + 100).alias("id"))
    return plan.uncovered(e, table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("id")), "id")


@query("""SELECT l_orderkey, list_sort(list_filter(range(1, hi + 1), lambda i: NOT list_contains(have, i)))::INTEGER[] AS missing, list_sort(list_filter(have, lambda i: i > hi))::INTEGER[] AS surplus
FROM (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have, CAST(count(*) AS INTEGER) AS hi FROM lineitem WHERE l_quantity > 10 GROUP BY 1)""")
def exact_cover(spark, sf):
    """Range against set, both ways."""
    found = table(spark, sf, "lineitem").filter("l_quantity > 10")
    return catalog.cover(found, ["l_orderkey"], "l_linenumber", F.lit(1), F.count("*").cast("int"))


@query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, upper(rtrim(p_type, '. '))) > 1 AS collides FROM part""")
def name_collisions(spark, sf):
    """J6, X8."""
    return plan.collisions(table(spark, sf, "part"), "p_brand", "p_type").select("p_partkey", "collides")


@query("""WITH p AS (SELECT c_name AS source, 'customer#' || lpad(CAST((c_custkey * 7) % 2000 AS VARCHAR), 9, '0') AS target FROM customer), h AS (SELECT upper(c_name) AS k, min(c_name) AS occupant, count(*) AS holders FROM customer GROUP BY 1)
SELECT source, target, occupant, coalesce(holders, 0) AS holders FROM p LEFT JOIN h ON upper(target) = k""")
def destination_occupants(spark, sf):
    """Who holds the name a row wants."""
    c = table(spark, sf, "customer")
    wants = c.select(F.col("c_name").alias("source"), F.concat(F.lit("customer#"), F.lpad(((F.col("c_custkey") * 7) % 2000).cast("string"), 9, "0")).alias("target"))
    return plan.occupants(wants, c.select(F.col("c_name").alias("place")))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey + 1 END AS waits_for, CASE WHEN s_acctbal < 0 THEN 'Failed' ELSE 'Planned' END AS state FROM supplier),
stuck(r) AS (SELECT row FROM p WHERE state <> 'Planned' UNION SELECT p.row FROM p JOIN stuck ON p.waits_for = r)
SELECT row, waits_for, CASE WHEN state = 'Planned' AND row IN (SELECT r FROM stuck) THEN 'Conflict' ELSE state END AS state FROM p""")
def blocked_chain(spark, sf):
    """G1: conflicts propagate along waits to a fixpoint."""
    s = table(spark, sf, "supplier")
    return plan.blocked(s.select(F.col("s_suppkey").alias("row"), F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey + 1 END").alias("waits_for"), F.expr("CASE WHEN s_acctbal < 0 THEN 'Failed' ELSE 'Planned' END").alias("state")))


@query("""SELECT count(*) FILTER (s = 0) AS planned, count(*) FILTER (s = 1) AS ambiguous, count(*) FILTER (s = 2) AS unknown, count(*) FILTER (s > 2) AS failed,
CAST(CASE WHEN count(*) FILTER (s > 2) > 0 THEN 1 WHEN count(*) FILTER (s = 1) > 0 THEN 3 WHEN count(*) FILTER (s = 2) > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM (SELECT o_orderkey % 5 AS s FROM orders)""")
def plan_tally(spark, sf):
    """A7."""
    o = table(spark, sf, "orders").withColumn("state", F.element_at(F.array(*map(F.lit, ("Planned", "Ambiguous", "Unknown", "Failed", "Conflict"))), (F.col("o_orderkey") % 5).cast("int") + 1))
    return plan.tally(o)


@query("""SELECT o_custkey, o_orderkey, outcome FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'Identified' WHEN 1 THEN 'Ambiguous' WHEN 2 THEN 'Unknown' ELSE 'Error' END AS outcome FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4, o_orderkey) = 1""")
def track_precedence(spark, sf):
    """Identified before Ambiguous before Unknown before errors, in track order."""
    names = F.array(*map(F.lit, ("Identified", "Ambiguous", "Unknown", "Error")))
    return plan.precedence(table(spark, sf, "orders").withColumn("outcome", F.element_at(names, (F.col("o_orderkey") % 4).cast("int") + 1)), "o_custkey", "o_orderkey", "outcome")


@query("""SELECT p_partkey, p_name, exact, position, CAST(row_number() OVER (ORDER BY exact DESC, position) AS INTEGER) AS choice, (SELECT count(*) FROM part) > 5 AS truncated
FROM (SELECT p_partkey, p_name, p_size = 7 AS exact, p_partkey AS position FROM part) QUALIFY row_number() OVER (ORDER BY exact DESC, position) <= 5""")
def show_choices(spark, sf):
    """Exact first, then provider order, five at most and a flag for more."""
    return catalog.top_choices(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), F.col("p_size") == 7, F.col("p_partkey")).drop("p_size")


@query("""WITH left_over AS (SELECT * FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)), once AS (SELECT * FROM left_over QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1)
SELECT l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM once QUALIFY rank <= 3""")
def fallback_choices(spark, sf):
    """The best three whose file is neither excluded nor a repeat."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    bad = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return catalog.fallback_choices(table(spark, sf, "lineitem"), bad, "l_partkey", "l_suppkey", order).select("l_partkey", "l_suppkey", "rank")


@query("""SELECT l_partkey, l_suppkey, l_returnflag, count(*) OVER (PARTITION BY l_partkey) > 1 AS conflict FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)""")
def collapsed_rows(spark, sf):
    """Equal rows collapse, differing ones conflict."""
    return catalog.collapsed(table(spark, sf, "lineitem"), "l_partkey", ["l_suppkey", "l_returnflag"])


@query("""SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    """A9."""
    return catalog.duplicate_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT o.o_orderkey, coalesce(c.v, o.o_custkey) AS o_custkey, c.v IS NOT NULL AS frozen FROM orders o LEFT JOIN (SELECT o_orderkey, o_custkey + 1 AS v FROM orders WHERE o_orderkey % 3 = 0) c USING (o_orderkey)
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def frozen_choices(spark, sf):
    """Only keys among the variants, a frozen choice before a ranked one."""
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem").filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    frozen = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"))
    return catalog.reuse_frozen(o, frozen, "o_orderkey", "o_custkey")


@query("""WITH r AS (SELECT DISTINCT c_nationkey, c_custkey % 50 AS low, c_custkey % 50 + 5 AS high FROM customer), m AS (SELECT s_nationkey AS c_nationkey, s_suppkey % 40 AS ml, s_suppkey % 40 + 20 AS mh, s_suppkey AS manifest FROM supplier)
SELECT c_nationkey, low, high, min(manifest) AS manifest, count(DISTINCT manifest) > 1 AS conflict FROM r JOIN m USING (c_nationkey) WHERE ml <= low AND high <= mh GROUP BY 1, 2, 3""")
def alias_match(spark, sf):
    """A request inside a frozen range of the same show."""
    r = table(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") % 50).alias("low"), (F.col("c_custkey") % 50 + 5).alias("high")).distinct()
    m = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 40).alias("low"), (F.col("s_suppkey") % 40 + 20).alias("high"), F.col("s_suppkey").alias("manifest"))
    return catalog.alias_match(r, m, ["c_nationkey"], "low", "high")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'error' WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'skip' ELSE 'ok' END AS verdict FROM orders""")
def eligibility(spark, sf):
    """a wrong identity is an error, an unfit row is skipped."""
    return catalog.eligible(table(spark, sf, "orders"), F.col("o_custkey") % 7 != 0, (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderstatus") == "P")).select("o_orderkey", "verdict")


@query("""SELECT c_custkey AS id, 'c' AS kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, 's' FROM supplier WHERE s_acctbal < 0""")
def alternatives_union(spark, sf):
    """Alternatives stay apart."""
    c, s = table(spark, sf, "customer").filter("c_acctbal < 0"), table(spark, sf, "supplier").filter("s_acctbal < 0")
    return c.select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("""SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS parts FROM part GROUP BY p_brand""")
def references_by_episode(spark, sf):
    """A13."""
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))


# --- ordered neighbours ------------------------------------------------------------------


@query("""SELECT event_id, value, before FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value < before""")
def start_regressions(spark, sf):
    """A start that falls behind the one before."""
    return ordered.regressions(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value", "before")


@query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM {LINES}) WHERE l_partkey <= before""")
def label_regressions(spark, sf):
    """Labels must rise strictly."""
    return ordered.regressions(lines(spark, sf), ["l_orderkey"], ["l_linenumber"], "l_partkey", strict=True).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type""")
def closed_intervals(spark, sf):
    """Unchanged displays vanish, the next change closes an interval."""
    return ordered.closed_intervals(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "ts", ["event_type"])


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_quantity AS BIGINT) AS e FROM {LINES})
SELECT l_orderkey, l_linenumber FROM (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) WHERE b > s""")
def overlapping_ranges(spark, sf):
    """W5, C3."""
    r = lines(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("s"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("e"))
    return ordered.overlaps(r, ["l_orderkey"], "s", "e", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate FROM orders)
SELECT o_custkey, o_orderkey, size FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY o_custkey) - 500000 AS excess FROM f) WHERE before < excess""")
def fifo_eviction(spark, sf):
    """The oldest go until the rest fits."""
    f = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"), "o_orderdate")
    return ordered.fifo_eviction(f, ["o_custkey"], ["o_orderdate", "o_orderkey"], "size", F.lit(500000)).select("o_custkey", "o_orderkey", "size")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS number FROM orders""")
def renumbering(spark, sf):
    """The stable sort needs the ordinal."""
    return ordered.renumbered(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "number")


@query(f"""SELECT l_orderkey, count(*) FILTER (a <> b) AS n_moved FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS b FROM {LINES}) GROUP BY 1""")
def moved_cues(spark, sf):
    """W12, O3."""
    return ordered.moved(lines(spark, sf), ["l_orderkey"], "l_shipdate", "l_linenumber")


@query("""SELECT user_id, cp AS checkpoint, count(*) AS n, max(value) AS top FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) JOIN (SELECT unnest([64, 128, 192])::INTEGER AS cp) ON p <= cp GROUP BY ALL""")
def progressive_checkpoints(spark, sf):
    """Every checkpoint sees its whole prefix."""
    return ordered.checkpoints(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).groupBy("user_id", "checkpoint").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
f(user_id, i, t, s, w) AS (SELECT user_id, i, t, t, CAST(0 AS BIGINT) FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - f.s >= 86400000000 THEN e.t ELSE f.s END, f.w + CASE WHEN e.t - f.s >= 86400000000 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, t AS ts, w AS "window" FROM f""")
def resetting_windows(spark, sf):
    """Windows that start where the last one ended."""
    ship(spark)
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return ordered.resetting_windows(e, "user_id", "ts", 86_400_000_000)


@query("""SELECT l_orderkey, max(CAST(l_partkey AS BIGINT) + coalesce(CAST(l_quantity AS BIGINT), 0)) AS duration FROM lineitem GROUP BY 1""")
def declared_duration(spark, sf):
    """W15."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_partkey").cast("long") + F.coalesce(F.col("l_quantity").cast("long"), F.lit(0))).alias("duration"))


# --- lookups and sample tables -----------------------------------------------------------


@query("""SELECT o_orderkey, c.event_id FROM (SELECT o_orderkey, o_custkey % 50 AS user_id, o_orderdate AS at FROM orders) o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM (SELECT user_id % 50 AS user_id, ts, event_id FROM events) GROUP BY 1, 2) c ON o.user_id = c.user_id AND o.at >= c.ts""")
def as_of_cue(spark, sf):
    """The last cue at or before a time; of equal times the last."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), "event_id")
    return ordered.as_of(o, e, ["user_id"], "at", "ts", "tie", "event_id").select("o_orderkey", "event_id")


@query("""SELECT user_id, coalesce(max(CASE WHEN ts <= TIMESTAMP '2024-01-15' THEN ts END), min(CASE WHEN ts > TIMESTAMP '2024-01-15' THEN ts END)) AS sample_pts FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1""")
def keyframe_at(spark, sf):
    """J13."""
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("m"))
    e = e.crossJoin(first).withColumn("sync", F.col("event_type") == F.col("m"))  # one row
    return ordered.keyframe_at(e, ["user_id"], "ts", "sync", F.lit("2024-01-15").cast("timestamp_ntz"))


_RUNS = f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 7 AS n, CAST(l_partkey AS BIGINT) % 100 + 1 AS dur FROM {LINES}"
_EXPANDED = f"SELECT l_orderkey, before + i AS sample, dur FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ({_RUNS})))"
_TIMED = f"SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY l_orderkey ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM ({_EXPANDED})"


def _samples(spark, sf):
    runs = lines(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 7).alias("n"), (F.col("l_partkey").cast("long") % 100 + 1).alias("dur"))
    return ordered.decode_times(ordered.expand_runs(runs, ["l_orderkey"], "l_linenumber", "n", "dur"), ["l_orderkey"], "dur")


@query(_TIMED)
def sample_times(spark, sf):
    """Run lengths to decode times."""
    return _samples(spark, sf)


@query(f"""SELECT s.l_orderkey, s.sample, s.dts, greatest(s.dts + coalesce(o.shift, 0), 0) AS pts, coalesce(k.n IS NOT NULL, false) AS sync FROM ({_TIMED}) s
LEFT JOIN (SELECT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS sample, CAST(l_suppkey AS BIGINT) % 50 - 25 AS shift FROM {LINES}) o ON o.l_orderkey = s.l_orderkey AND o.sample = s.sample
LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM {LINES} WHERE l_returnflag = 'R') k ON k.l_orderkey = s.l_orderkey AND k.n - 1 = s.sample""")
def presentation_times(spark, sf):
    """Sync flags and pts, missing offsets as zero, never below zero."""
    li = lines(spark, sf)
    offsets = li.select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("sample"), (F.col("l_suppkey").cast("long") % 50 - 25).alias("offset"))
    sync = li.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("number"))
    return ordered.sync_flags(ordered.presentation_times(_samples(spark, sf), offsets, ["l_orderkey"]), sync, ["l_orderkey"]).select("l_orderkey", "sample", "dts", "pts", "sync")


def _offsets_of(runs: DataFrame) -> DataFrame:
    chunks = runs.groupBy("k").agg((F.max("first_chunk") + 1).alias("m")).select("k", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("chunk")).withColumn("offset", F.col("chunk") * 1000)
    sizes = runs.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("sample")).withColumn("size", 10 + F.col("sample") % 5)
    return ordered.chunk_offsets(chunks, runs, sizes, ["k"])


@query(f"""WITH runs AS (SELECT l_orderkey AS k, l_linenumber * 2 - 1 AS first_chunk, CAST(l_quantity AS BIGINT) % 3 + 1 AS per FROM {LINES}),
n AS (SELECT k, max(first_chunk) + 1 AS m FROM runs GROUP BY k), chunks AS (SELECT k, unnest(range(1, m + 1)) AS chunk FROM n),
held AS (SELECT c.k, c.chunk, r.per, CAST(c.chunk * 1000 AS BIGINT) AS base FROM chunks c ASOF JOIN runs r ON c.k = r.k AND c.chunk >= r.first_chunk),
firsts AS (SELECT *, CAST(coalesce(sum(per) OVER (PARTITION BY k ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM held),
placed AS (SELECT k, chunk, base, before + i AS sample FROM (SELECT *, unnest(range(per)) AS i FROM firsts)),
sized AS (SELECT *, 10 + sample % 5 AS size FROM placed WHERE sample < 12)
SELECT k, sample, CAST(base + coalesce(sum(size) OVER (PARTITION BY k, chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM sized""")
def chunk_offsets(spark, sf):
    """Chunks, runs and sizes to offsets; surplus chunks are ignored."""
    runs = lines(spark, sf).select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 2 - 1).cast("long").alias("first_chunk"), (F.col("l_quantity").cast("long") % 3 + 1).alias("per_chunk"))
    return _offsets_of(runs)


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS item, CAST(l_partkey AS BIGINT) AS s, CAST(l_quantity AS BIGINT) AS n FROM lineitem), b AS (SELECT o_orderkey AS k, o_custkey AS lo, o_custkey + 1000 AS hi FROM orders)
SELECT e.k, item, bool_and(coalesce(s >= lo AND s + n <= hi, false)) AS inside FROM e LEFT JOIN b ON e.k = b.k GROUP BY e.k, item""")
def contained_extents(spark, sf):
    """Every extent inside a box."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("item"), F.col("l_partkey").cast("long").alias("start"), F.col("l_quantity").cast("long").alias("length"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("box_start"), (F.col("o_custkey") + 1000).alias("box_end"))
    return ordered.contained(e, b, ["k"], "item")


@query("""WITH a AS (SELECT s_suppkey AS item, s_nationkey % 5 AS k, [s_suppkey % 4, s_suppkey % 9, 2] AS ix FROM supplier), e AS (SELECT item, k, unnest(ix) AS number, generate_subscripts(ix, 1) AS p FROM a), p AS (SELECT r_regionkey AS k, unnest(range(1, 6)) AS number, r_name FROM region)
SELECT k, item, list(r_name || '-' || number ORDER BY p) AS properties FROM e JOIN p USING (k, number) GROUP BY k, item""")
def item_properties(spark, sf):
    """Associations by position; 0 and beyond are skipped, order stays."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_nationkey") % 5).alias("k"), F.array(F.col("s_suppkey") % 4, F.col("s_suppkey") % 9, F.lit(2).cast("long")).alias("indexes"))
    p = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("number"), "r_name").withColumn("property", F.concat("r_name", F.lit("-"), F.col("number").cast("string")))
    return ordered.properties_of(a, p, ["k"], "item")


# --- ledgers -----------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS n, sha256(unhex(hex('moved') || string_agg(lpad(hex(l_linenumber), 8, '0'), '' ORDER BY l_linenumber))) AS sha256 FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def ledger_digests(spark, sf):
    """Digests of ordered ordinals."""
    return ledger.ordinal_digest(table(spark, sf, "lineitem").filter("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber", "moved")


@query("""WITH a AS (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT)) AS s, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS p FROM orders GROUP BY 1), b AS (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT)) AS s, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS p FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey FROM a FULL JOIN b USING (o_custkey) WHERE a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""")
def ledger_mismatches(spark, sf):
    """Recompute and compare, null equal to null."""
    made = lambda rows: rows.groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("s"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("p"))
    o = table(spark, sf, "orders")
    return ledger.ledger_mismatches(made(o), made(o.filter("o_orderkey % 10 <> 0")), ["o_custkey"], ["s", "p"])


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_and(l_discount = 0)""")
def proven_empty(spark, sf):
    """Records, and every one without text."""
    return ledger.proven_empty(table(spark, sf, "lineitem").withColumn("missing", F.col("l_discount") == 0), "l_orderkey", "missing")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY ALL""")
def inventory(spark, sf):
    """A15."""
    return ledger.inventory(table(spark, sf, "orders").withColumn("size", F.floor("o_totalprice")), ["o_orderpriority", "o_orderstatus"], "size")


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber AS step, CAST(l_linenumber AS BIGINT) AS f, CAST(l_linenumber + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS BIGINT) AS t, lag(CAST(l_linenumber + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pt FROM {LINES}),
g AS (SELECT l_orderkey, count(*) <= 3 AND max(step) = count(*) AND bool_and(pt IS NULL OR pt = f) AS valid, arg_max(t, step) AS last FROM h GROUP BY 1) SELECT l_orderkey, CASE WHEN valid THEN last END AS current, valid FROM g""")
def history_replay(spark, sf):
    """Steps 1..3 without gaps, each from where the last led."""
    li = lines(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("step"), F.col("l_linenumber").cast("long").alias("from_id"), (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 2).otherwise(1)).cast("long").alias("to_id"))
    return ledger.replay(li, "l_orderkey")


# --- functions ---------------------------------------------------------------------------


@query("""SELECT o_orderkey, printf('S%02dE%02d %s', CAST(o_custkey % 99 + 1 AS INTEGER), CAST(o_orderkey % 120 + 1 AS INTEGER), o_orderpriority) AS label, CAST(o_custkey % 99 + 1 AS INTEGER) AS season, CAST(o_orderkey % 120 + 1 AS INTEGER) AS episode FROM orders""")
def episode_labels(spark, sf):
    """Written and read back."""
    o = table(spark, sf, "orders").select("o_orderkey", x.code_label((F.col("o_custkey") % 99 + 1).cast("int"), (F.col("o_orderkey") % 120 + 1).cast("int"), F.col("o_orderpriority")).alias("label"))
    return o.withColumn("p", x.parse_label(F.col("label"))).select("o_orderkey", "label", "p.season", "p.episode")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') AS safe, upper(rtrim(url, '. ')) AS key FROM pages""")
def safe_names(spark, sf):
    """X6, X8."""
    return table(spark, sf, "pages").select("page_id", x.safe_component(F.col("url")).alias("safe"), x.collision_key(F.col("url")).alias("key"))


@query("""SELECT page_id, replace(url_encode(url), '%20', '+') AS encoded FROM pages""")
def form_encoding(spark, sf):
    """X12."""
    return table(spark, sf, "pages").select("page_id", x.form_encode(F.col("url")).alias("encoded"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') = '')) AS n_blank, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> ''), chr(10)) AS text FROM documents""")
def interior_blanks(spark, sf):
    """X15, X16."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda line: x.trimmed(line) == "")).cast("long").alias("n_blank"), x.drop_blank_lines(x.line_feeds(F.col("text"))).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 AND o_custkey > 0 THEN o_custkey END AS imdb, CASE WHEN o_orderkey % 3 = 0 AND o_custkey BETWEEN 1 AND 999 THEN o_custkey END AS bounded FROM orders""")
def number_parsing(spark, sf):
    """Strict digits, bounds."""
    o = table(spark, sf, "orders")
    imdb = F.concat(F.when(F.col("o_orderkey") % 4 == 1, "t").otherwise("tt"), F.col("o_custkey").cast("string"))
    plain = F.concat(F.element_at(F.array(F.lit(""), F.lit("+"), F.lit(" ")), (F.col("o_orderkey") % 3).cast("int") + 1), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", x.imdb_number(imdb).alias("imdb"), x.bounded_int(plain, 1, 999).alias("bounded"))


@query("""SELECT o_orderkey, ms, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, ms AS parsed, ms AS lenient FROM (SELECT o_orderkey, (o_orderkey * 7919) % 360000000 AS ms FROM orders)""")
def timestamp_round_trip(spark, sf):
    """T1, T2, T4."""
    o = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 360000000).alias("ms")).withColumn("stamp", t.stamp(F.col("ms")))
    return o.select("o_orderkey", "ms", "stamp", t.strict_ms(F.col("stamp")).alias("parsed"), t.clock_ms(F.col("stamp")).alias("lenient"))


@query("""SELECT o_orderkey, s AS start_ms, s + 1500 AS end_ms, CASE WHEN o_orderkey % 2 = 0 THEN [1, 2, 3, 4]::BIGINT[] END AS placement FROM (SELECT o_orderkey, (o_orderkey * 991) % 3600000 AS s FROM orders)""")
def timing_rows(spark, sf):
    """T3."""
    o = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 991) % 3600000).alias("s"))
    line = F.concat(t.stamp(F.col("s")), F.lit(" --> "), t.stamp(F.col("s") + 1500), F.when(F.col("o_orderkey") % 2 == 0, " X1:1 X2:2 Y1:3 Y2:4").otherwise(""))
    return o.withColumn("r", t.timing_row(line)).select("o_orderkey", "r.start_ms", "r.end_ms", "r.placement")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey * 1234567 AS ns, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * 1234567) // 1000000 + o_orderkey % 5 - 2 END AS e FROM orders)
SELECT o_orderkey, ns // 1000000 AS start_ms, CASE WHEN e IS NULL OR e <= ns // 1000000 THEN ns // 1000000 + 1 ELSE e END AS end_ms, e IS NULL OR e <= ns // 1000000 AS synthetic FROM o""")
def cue_ends(spark, sf):
    """T6, T7."""
    o = table(spark, sf, "orders").select("o_orderkey", t.floor_ms(F.col("o_orderkey") * 1234567).cast("long").alias("start_ms"))
    o = o.withColumn("e", F.when(F.col("o_orderkey") % 3 != 0, F.col("start_ms") + F.col("o_orderkey") % 5 - 2))
    return o.withColumn("c", t.closed_end(F.col("start_ms"), F.col("e"))).select("o_orderkey", "start_ms", "c.end_ms", "c.synthetic")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5000 AS media, CAST(100 AS BIGINT) AS es, CAST(2000 AS BIGINT) AS el, o_custkey % 50 AS d FROM orders)
SELECT o_orderkey, CASE WHEN media >= es AND (media - es) * 600 < el * 90000 THEN CAST((CAST(d AS HUGEINT) * 90000 + CAST(media - es AS HUGEINT) * 600) * 1000000000 // (90000 * 600) AS BIGINT) END AS ns FROM o""")
def edit_times(spark, sf):
    """One edit, exact rationals."""
    lit = lambda n: F.lit(n).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", t.edited_ns(F.col("o_orderkey") % 5000, lit(100), lit(2000), F.col("o_custkey") % 50, lit(90000), lit(600)).alias("ns"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey + d >= 0 THEN (o_custkey + d) * 1000000 END AS ns, m, b >= 3 AND (b + 1 >= a OR 5 * b >= 4 * a) AS competes FROM (SELECT *, o_orderkey % 3000 - 1500 AS d, (o_orderkey % 100 - 50) + (o_custkey % 99) // 2 AS m, o_orderkey % 12 AS a, o_custkey % 12 AS b FROM orders)""")
def tick_math(spark, sf):
    """T8, T10, T12."""
    o = table(spark, sf, "orders")
    low = F.col("o_orderkey") % 100 - 50
    return o.select("o_orderkey", t.ticks_ns(F.col("o_custkey"), F.col("o_orderkey") % 3000 - 1500, F.lit(1_000_000).cast("long")).alias("ns"), t.offset_midpoint(low, low + F.col("o_custkey") % 99).cast("long").alias("m"), t.competes(F.col("o_orderkey") % 12, F.col("o_custkey") % 12).alias("competes"))


@query("""SELECT c_custkey, c_custkey % 3 <> 1 AS enabled, c_custkey % 5 <> 0 AS is_default, c_custkey % 4 = 0 AS forced, CASE WHEN c_custkey % 2 = 0 THEN 'en-GB' WHEN c_custkey % 7 = 0 THEN 'fre' ELSE 'eng' END AS language FROM customer""")
def track_settings(spark, sf):
    """Declared flags, defaults where absent."""
    c = table(spark, sf, "customer")
    flag = lambda cond, v: F.when(cond, F.lit(v))
    k = F.col("c_custkey")
    tracks = c.select(k.alias("track"), flag(k % 3 == 1, False).alias("enabled"), flag(k % 5 == 0, False).alias("is_default"), flag(k % 4 == 0, True).alias("forced"), flag(k % 2 == 0, "en-GB").alias("ietf"), flag(k % 7 == 0, "fre").alias("language"))
    return ordered.track_settings(tracks).withColumnRenamed("track", "c_custkey")


@query("""SELECT o_orderkey * 1000000 AS ts_ns, track, o_custkey + track AS position FROM orders, (SELECT unnest([1, 2])::BIGINT AS track)""")
def cue_points(spark, sf):
    """C11."""
    k = F.col("o_custkey")
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("time"), F.array(*(F.struct(F.lit(n).cast("long").alias("track"), (k + n).alias("position")) for n in (1, 2))).alias("positions"))
    return ordered.cue_points(p, F.lit(1_000_000).cast("long"))


@query("""SELECT o_orderkey, NOT (o_orderkey % 4 = 0) AS conflict FROM orders""")
def label_conflicts(spark, sf):
    """names that speak for another episode, for two, or for a pack."""
    names = ("Show.S01E02.1080p", "Show 1x03", "Show.S01E02 S01E04", "Show Season Pack S01E02")
    o = table(spark, sf, "orders")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 4).cast("int") + 1)
    return o.select("o_orderkey", x.label_conflict(name, F.lit(1), F.lit(2)).alias("conflict"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A & B' WHEN 1 THEN 'A &amp; B' ELSE 'é' END AS title, c_custkey % 3 <> 1 AS agrees FROM customer""")
def title_references(spark, sf):
    """One layer of character references."""
    ship(spark)
    raw = F.element_at(F.array(F.lit("A &amp; B"), F.lit("A &amp;amp; B"), F.lit("&#233;")), (F.col("c_custkey") % 3).cast("int") + 1)
    target = F.element_at(F.array(F.lit("A & B"), F.lit("A & B"), F.lit("é")), (F.col("c_custkey") % 3).cast("int") + 1)
    return table(spark, sf, "customer").select("c_custkey", x.decode_references(raw).alias("title"), x.titles_agree(raw, target).alias("agrees"))


@query("""SELECT doc_id, text <> '' AND trim(text) = text AND octet_length(encode(text)) <= 1024 AND NOT contains(text, chr(10)) AS valid FROM documents""")
def metadata_validity(spark, sf):
    """F4, X4."""
    return table(spark, sf, "documents").select("doc_id", x.clean_name(F.col("text")).alias("valid"))


@query("""SELECT c_custkey, lower(c_name) = lower(upper(c_name)) AS same FROM customer""")
def ascii_equality(spark, sf):
    """X13."""
    return table(spark, sf, "customer").select("c_custkey", x.same_ascii(F.col("c_name"), F.upper("c_name")).alias("same"))


@query("""SELECT user_id, count(*) AS frames, count(*) FILTER (props IS NULL OR props = '{}') AS empty, count(*) FILTER (same) AS unchanged, CAST(sum(CASE WHEN NOT same THEN event_id % 100 ELSE 0 END) AS BIGINT) AS pixels FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type, false) AS same FROM events) GROUP BY 1""")
def frame_counters(spark, sf):
    """Frames, empty, unchanged and pixels."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    same = F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == F.col("event_type"), F.lit(False))
    e = e.withColumn("same", same)
    return e.groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("props").isNull() | (F.col("props") == "{}")).alias("empty"), F.count_if("same").alias("unchanged"), F.sum(F.when(~F.col("same"), F.col("event_id") % 100).otherwise(0)).alias("pixels"))
