"""Queries of intervals at second resolution and of scans over one sequence of all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import intervals as I
from schedlake.operators import lunar as L
from schedlake.plans.calendars import text_dates
from schedlake.plans.lunars import SEGMENT_SQL
from schedlake.plans.registry import query

SECONDS = "epoch_us(ts) // 1000000"


def events(v):
    """Events with whole seconds and microseconds, and a span of up to 5,000 seconds from each."""
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return v.table("events").select(
        "event_id", "user_id", "event_type", "value", seconds.alias("at"), (seconds + (F.col("event_id") * 37) % 5000).alias("until"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("us"))


@query("interval_lookup_seconds", "v_lunar", sql="WITH " + SEGMENT_SQL.strip() + """,
o AS (SELECT o_orderkey, epoch(CAST(o_orderdate AS TIMESTAMP))::BIGINT + o_orderkey * 7919 % 86400 AS second FROM orders)
SELECT o_orderkey, second, CAST(sg.start AS VARCHAR) AS start, CAST((second - epoch(CAST(sg.start AS TIMESTAMP))::BIGINT) // 86400 AS BIGINT) AS "offset"
FROM o LEFT JOIN sg ON second >= epoch(CAST(sg.start AS TIMESTAMP))::BIGINT AND second < epoch(CAST(sg.start AS TIMESTAMP))::BIGINT + days * 86400""")
def interval_lookup_seconds(v):
    """The month segment that holds each order's second."""
    second = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000") + (F.col("o_orderkey") * 7919) % 86400
    first = F.unix_date("start").cast("long") * 86400
    segments = L.segments(v.lunar_days()).select("start", first.alias("from_s"), (first + F.col("days") * 86400 - 1).alias("to_s"))
    found = I.containing(v.table("orders").select("o_orderkey", second.alias("second")), "second", segments, "from_s", "to_s", how="left")
    return text_dates(found.select("o_orderkey", "second", "start", F.expr("(second - from_s) div 86400").alias("offset")), "start")


@query("interval_containment", sql=f"""
WITH e AS (SELECT event_id, user_id, {SECONDS} AS at, {SECONDS} + event_id * 37 % 5000 AS until FROM events)
SELECT p.event_id, count(i.event_id) AS n, min(i.event_id) AS first_interval, coalesce(max(i.until - i.at), -1) AS longest
FROM e p LEFT JOIN e i ON p.at BETWEEN i.at AND i.until GROUP BY 1""")
def interval_containment(v):
    """How many of all events' spans hold each event's second, over one axis."""
    e = events(v)
    spans = e.select(F.col("event_id").alias("span_id"), F.col("at").alias("from_s"), F.col("until").alias("to_s"))
    met = I.containing(e.select("event_id", "at"), "at", spans, "from_s", "to_s", how="left", totals={
        "n": ("count", F.col("span_id")), "first_interval": ("min", F.col("span_id")), "longest": ("max", F.col("to_s") - F.col("from_s"))})
    return met.groupBy("event_id").agg(
        F.sum("n").alias("n"), F.min("first_interval").alias("first_interval"), F.coalesce(F.max("longest"), F.lit(-1)).alias("longest"))


@query("interval_containment_by_key", sql=f"""
WITH e AS (SELECT event_id, user_id, {SECONDS} AS at, {SECONDS} + event_id * 37 % 5000 * 100 AS until FROM events)
SELECT p.event_id, i.event_id AS span_id FROM e p JOIN e i ON p.user_id = i.user_id AND p.at BETWEEN i.at AND i.until""")
def interval_containment_by_key(v):
    """Events within the spans of their own user."""
    e = events(v)
    long = F.col("at") + (F.col("until") - F.col("at")) * 100
    spans = e.select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("from_s"), long.alias("to_s"))
    return I.containing(e.select("event_id", "user_id", "at"), "at", spans, "from_s", "to_s", scope=["user_id"]).select("event_id", "span_id")


@query("sequence_asof", sql="""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase,
  last_value(CASE WHEN user_id % 97 = 0 THEN event_id END IGNORE NULLS) OVER w AS last_marked, max(value) OVER w AS highest
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def sequence_asof(v):
    """Last purchase value, last event of a marked user and highest value so far, along all events in one sequence."""
    e = events(v)
    carried = I.last_value(e, ["us", "event_id"], {
        "last_purchase": F.when(F.col("event_type") == "purchase", F.col("value")), "last_marked": F.when(F.col("user_id") % 97 == 0, F.col("event_id"))})
    return I.running_max(carried, ["us", "event_id"], "value", "highest").select("event_id", "last_purchase", "last_marked", "highest")


@query("sequence_islands", sql="""
WITH e AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) + event_id * 37 % 50 * 1000000 AS until FROM events),
r AS (SELECT *, max(until) OVER (ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR us > reach + 1000000 THEN 1 ELSE 0 END) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS low, min(us) AS first_us, max(until) AS last_us FROM n GROUP BY 1""")
def sequence_islands(v):
    """Stretches of all events, spans included, that no gap of over a second divides."""
    e = events(v).select("event_id", "us", (F.col("us") + (F.col("event_id") * 37) % 50 * 1000000).alias("until"))
    numbered = I.islands(e, ["us", "event_id"], "us", "until", 1_000_000)
    return numbered.groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.min("us").alias("first_us"), F.max("until").alias("last_us"))
