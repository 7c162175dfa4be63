"""Streaming queries (ST1-ST6): bounded runs over the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.plans.views import r6
from gridloom.sources.sinks import staging
from gridloom.streaming import operators as ops
from gridloom.streaming import runs


def money():
    return F.col("value").cast("decimal(12,2)")


def events(v):
    return runs.table_stream(v.spark, v.sf_dir, "events")


def in_days(v, parts=3):
    """A stream over a folder, and the steps that add the events to it in order of time, one part each."""
    out = staging(v.spark, "parts")
    table = v.table("events")
    first, last = table.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    step = (last - first).days // parts + 1
    day = F.datediff(F.to_date("ts"), F.lit(first))

    def add(i):
        return lambda: table.where((day >= i * step) & (day < (i + 1) * step)).write.parquet(f"{out}/{i}")

    table.where("false").write.parquet(f"{out}/none")
    stream = runs.folder_stream(v.spark, out, table.schema, nested=True)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), [add(i) for i in range(parts)]


def daily(stream):
    rolled = ops.rollup(stream, "ts", "1 day", "1 day", ["user_id"], [(F.sum(money()).cast("double") / F.count("*")).alias("x")])
    return rolled.select("w", "user_id", "x")


@query("ST1_stream_ema", """s AS (SELECT user_id, day, x, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM v_series),
    e AS (SELECT user_id, day, rn, x AS state FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.day, s.rn, (1 - exp(-0.1::DOUBLE)) * s.x + (1 - (1 - exp(-0.1::DOUBLE))) * e.state FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1)
    SELECT user_id, day, R6(state) AS state, 0::BIGINT AS late FROM e""")
def _(v):
    def periods(stream):
        return daily(stream).select("user_id", F.unix_date(F.to_date("w.start")).cast("bigint").alias("t"), "x")

    # closed periods are appended to a table; the state query streams that table
    path, _ = runs.drain_windows_to_folder(events(v), "ts", periods, "st1_periods")
    closed = runs.folder_stream(v.spark, path, periods(events(v)).schema)
    rows, _ = runs.drain(ops.ema_state(closed, "user_id", "t", "x"), "st1")
    return rows.select("user_id", F.date_from_unix_date(F.col("t").cast("int")).alias("day"), r6(F.col("state")).alias("state"), "late")


@query("ST2_period_rollup", """w AS (SELECT event_type, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY ALL)
    SELECT event_type, CAST(start AS DATE) AS start, n, total FROM w""")
def _(v):
    def weekly(stream):
        rolled = ops.rollup(stream, "ts", "7 days", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum(money()).cast("double").alias("total")])
        return rolled.select("event_type", F.to_date("w.start").alias("start"), "n", "total")

    stream, feeds = in_days(v)
    return runs.drain_windows(stream, "ts", weekly, "st2", feeds=feeds)[0]


@query("ST3_sliding_pool", """d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, CAST(day - CAST(o AS INTEGER) AS DATE) AS start, sum(n)::BIGINT AS n FROM d, range(0, 5) AS g(o) GROUP BY ALL)
    SELECT user_id, start, n FROM s""")
def _(v):
    def pooled(stream):
        rolled = ops.rollup(stream, "ts", "5 days", "1 day", ["user_id"], [F.count("*").alias("n")], slide="1 day")
        return rolled.select("user_id", F.to_date("w.start").alias("start"), "n")

    return runs.drain_windows(events(v), "ts", pooled, "st3")[0]


@query("ST4_stream_mask_clean", """e AS (SELECT event_id, CAST(user_id % 40 AS INTEGER) AS row, CAST(event_id % 32 AS INTEGER) AS col, CASE event_type WHEN 'error' THEN NULL ELSE value END AS value FROM events), j AS (SELECT e.* FROM e JOIN v_land USING (row, col))
    SELECT event_id, row, col, value, (SELECT count(*) FROM j WHERE value < 5) AS violations FROM j""")
def _(v):
    cells = events(v).select(
        "event_id", F.pmod("user_id", F.lit(40)).cast("int").alias("row"), F.pmod("event_id", F.lit(32)).cast("int").alias("col"),
        F.when(F.col("event_type") == "error", -9999.0).otherwise(F.col("value")).alias("value"),
    )
    rows, counters = runs.drain(ops.masked_clean(cells, v.grid(), 5.0).select("event_id", "row", "col", "value"), "st4")
    return rows.withColumn("violations", F.lit(counters["range.violations"]).cast("bigint"))


@query("ST5_stream_lockstep", """a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS others FROM events WHERE event_type <> 'click' GROUP BY ALL)
    SELECT user_id, day, clicks, others FROM a JOIN b USING (user_id, day)""")
def _(v):
    def both(stream):
        a = ops.rollup(stream.where("event_type = 'click'"), "ts", "1 day", "1 day", ["user_id"], [F.count("*").alias("clicks")])
        b = ops.rollup(stream.where("event_type <> 'click'"), "ts", "1 day", "1 day", ["user_id"], [F.count("*").alias("others")])
        return ops.lockstep(a, b, ["user_id"]).select("user_id", F.to_date("w.start").alias("day"), "clicks", "others")

    # one end row on each side of the join
    return runs.drain_windows(events(v), "ts", both, "st5", [{"event_type": "click", "user_id": 0}, {"event_type": "end", "user_id": 0}])[0]


@query("ST6_stream_deduplicate", "SELECT event_id, user_id, event_type, value FROM events")
def _(v):
    twice = events(v).unionByName(events(v))
    rows, _ = runs.drain(ops.deduplicate(twice, "ts", "31 days", ["event_id"]).select("event_id", "user_id", "event_type", "value"), "st6")
    return rows
