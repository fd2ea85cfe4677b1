"""Registered queries: sources, sinks and the streaming form of A5."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenure.operators import activity as act
from tenure.plans.fixture import YEAR_END, YEAR_START
from tenure.plans.registry import ORACLES, QUERIES, register, with_views
from tenure.sources import ingest, views
from tenure.sources.tables import read_table
from tenure.streaming.daily import SCHEMA, daily_stream, read_windows
from tenure.streaming.monthly import monthly_stream, read_monthly

from tenure.plans import q_activity, q_segments  # noqa: F401  (oracles reused below)


def _run_dir(spark, name):
    return ingest.shared_path(spark, "runs", f"{name}-{uuid.uuid4().hex[:8]}")


# ---------------------------------------------------------------- S1 / S3
@register("s1_csv_union_ingest", with_views("", f"""
SELECT user_id, p_mt, cancel_yn, NULL AS tv_hours FROM panel WHERE p_mt < {YEAR_START}
UNION ALL
SELECT user_id, p_mt, NULL AS cancel_yn, tv_hours FROM panel WHERE p_mt >= {YEAR_START}"""))
def s1_csv_union_ingest(spark, sf_dir):
    """Two CSV extracts with different headers, read per file and united by name."""
    panel = views.panel(spark, sf_dir)
    root = _run_dir(spark, "s1")
    ingest.write_csv(panel.filter(F.col("p_mt") < YEAR_START).select("user_id", "p_mt", "cancel_yn"), f"{root}/a_cancel")
    ingest.write_csv(panel.filter(F.col("p_mt") >= YEAR_START).select("user_id", "p_mt", "tv_hours"), f"{root}/b_cancel")
    return ingest.read_csv_union(spark, ingest.list_paths(spark, f"{root}/*_cancel"), types={"user_id": "bigint"})


# ---------------------------------------------------------------- S2
@register("s2_first_csv", with_views("", "SELECT asset_id, asset_nm, asset_prod, adult_yn FROM content WHERE asset_prod = 0"))
def s2_first_csv(spark, sf_dir):
    content = views.content(spark, sf_dir)
    root = _run_dir(spark, "s2")
    ingest.write_csv(content.filter(F.col("asset_prod") == 0), f"{root}/a_vod_mart")
    ingest.write_csv(content.filter(F.col("asset_prod") != 0), f"{root}/b_vod_mart")
    return ingest.read_first_csv(spark, f"{root}/*vod_mart*", types={"asset_id": "bigint"})


# ---------------------------------------------------------------- S4 / S5
@register("s4_s5_projected_scan", with_views("", "SELECT o_custkey, o_orderdate, o_totalprice FROM orders"))
def s4_s5_projected_scan(spark, sf_dir):
    """Three columns of all orders: the column list reaches the parquet scan."""
    return read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])


# ---------------------------------------------------------------- S6
SUMMER = (YEAR_START + 5, YEAR_START + 7)


@register("s6_parquet_sink", "SELECT * FROM (" + ORACLES["a5_monthly_activity"] +
          f") WHERE p_mt BETWEEN {SUMMER[0]} AND {SUMMER[1]}")
def s6_parquet_sink(spark, sf_dir):
    """Monthly activity written partitioned by month; reading three months prunes the other directories."""
    path = _run_dir(spark, "s6")
    ingest.write_parquet(QUERIES["a5_monthly_activity"](spark, sf_dir), path, partition_by=["p_mt"])
    back = spark.read.parquet(path).filter(F.col("p_mt").between(*SUMMER))
    return back.select("user_id", F.col("p_mt").cast("int").alias("p_mt"), "vod_view_cnt", "vod_use_tms_sum")


# ---------------------------------------------------------------- S7
@register("s7_csv_sink", ORACLES["a12_monthly_trend"])
def s7_csv_sink(spark, sf_dir):
    """CSV export of the monthly trend, read back with the written schema (no type guessing)."""
    path = _run_dir(spark, "s7")
    trend = QUERIES["a12_monthly_trend"](spark, sf_dir)
    ingest.write_csv(trend, path)
    return spark.read.option("header", True).schema(trend.schema).csv(path)


# ---------------------------------------------------------------- S8
@register("s8_json_report", ORACLES["a10_label_counts"])
def s8_json_report(spark, sf_dir):
    path = _run_dir(spark, "s8")
    ingest.write_json(QUERIES["a10_label_counts"](spark, sf_dir), path)
    back = spark.read.json(path)
    return back.select(F.col("cancel_yn").cast("int").alias("cancel_yn"), F.col("cnt").cast("bigint").alias("cnt"),
                       F.col("pct").cast("double").alias("pct"))


# ---------------------------------------------------------------- S9
@register("s9_table_store", with_views("", """
SELECT 'activity' AS table_name, COUNT(*) AS n FROM activity UNION ALL
SELECT 'content', COUNT(*) FROM content UNION ALL SELECT 'panel', COUNT(*) FROM panel"""))
def s9_table_store(spark, sf_dir):
    root = _run_dir(spark, "s9")
    ingest.save_tables({"activity": views.activity(spark, sf_dir), "content": views.content(spark, sf_dir),
                        "panel": views.panel(spark, sf_dir)}, root)
    parts = [ingest.load_table(spark, root, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"))
             for n in ("activity", "content", "panel")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BUCKETS = 16


@register("s9_bucketed_store", with_views("", """
SELECT p.user_id, p.p_mt, CAST(COALESCE(a.n, 0) AS BIGINT) AS vod_view_cnt, CAST(COALESCE(m.n, 0) AS BIGINT) AS month_view_cnt
FROM panel p LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM activity GROUP BY 1) a ON p.user_id = a.user_id
LEFT JOIN (SELECT user_id, CAST(SUBSTR(strt_dt, 1, 6) AS INT) AS p_mt, COUNT(*) AS n FROM activity WHERE strt_dt IS NOT NULL GROUP BY 1, 2) m
  ON p.user_id = m.user_id AND p.p_mt = m.p_mt"""))
def s9_bucketed_store(spark, sf_dir):
    """Catalog tables bucketed by user: the log restricted to the panel's users, per-user and per-month counts attached, no shuffle."""
    log, panel = bucketed_tables(spark, sf_dir)
    return bucketed_counts(log, panel)


def bucketed_tables(spark, sf_dir, buckets: int = BUCKETS):
    root, tag = _run_dir(spark, "s9b"), uuid.uuid4().hex[:8]
    log = views.activity(spark, sf_dir, with_month=True).select("user_id", "p_mt")
    names = {f"activity_{tag}": log, f"panel_{tag}": views.panel(spark, sf_dir).select("user_id", "p_mt")}
    return [ingest.save_bucketed(df, name, f"{root}/{name}", "user_id", buckets) for name, df in names.items()]


def bucketed_counts(log, panel):
    """J1, J4 and J5 over tables that share their buckets."""
    mine = log.join(panel.select("user_id"), "user_id", "left_semi")
    total = mine.groupBy("user_id").agg(F.count(F.lit(1)).alias("vod_view_cnt"))
    month = mine.where("p_mt IS NOT NULL").groupBy("user_id", "p_mt").agg(F.count(F.lit(1)).alias("month_view_cnt"))
    out = panel.join(total, "user_id", "left").join(month, ["user_id", "p_mt"], "left")
    return out.select("user_id", "p_mt", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("vod_view_cnt", "month_view_cnt")])


# ---------------------------------------------------------------- A5 as a stream
@register("a5_streaming_monthly", ORACLES["a5_monthly_activity"])
def a5_streaming_monthly(spark, sf_dir):
    """The flagship aggregate maintained by a streaming job over the log files; equals the batch result."""
    root = _run_dir(spark, "stream")
    src, target = f"{root}/source", f"{root}/target"
    log = views.activity(spark, sf_dir)
    ingest.write_parquet(log, src)
    panel = views.panel(spark, sf_dir)
    users = panel.filter(F.col("p_mt").between(YEAR_START, YEAR_END)).select("user_id")
    q = monthly_stream(spark, src, log.schema, users, YEAR_START, YEAR_END, target, checkpoint=f"{root}/ckpt")
    q.awaitTermination()
    return read_monthly(spark, target)


# ---------------------------------------------------------------- event-time windows over the events
@register("events_daily_stream", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, COUNT(*) AS n_events, COUNT(value) AS n_valued,
       CAST(COALESCE(SUM(CAST(ROUND(value * 100) AS BIGINT)), 0) AS BIGINT) AS value_cents
FROM (SELECT DISTINCT event_id, ts, event_type, value FROM events WHERE ts IS NOT NULL) e
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""")
def events_daily_stream(spark, sf_dir):
    """Daily windows of the events that the watermark has closed: those that end two days before the last event."""
    root = _run_dir(spark, "daily")
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    ingest.write_parquet(events.select(*[F.col(c).cast(t) for c, t in (f.split() for f in SCHEMA.split(", "))]), f"{root}/source")
    daily_stream(spark, f"{root}/source", f"{root}/target", f"{root}/ckpt").awaitTermination()
    return read_windows(spark, f"{root}/target")


_ = act
