"""Stand-in views over the driver tables.

The reference reads three inputs: a viewing log, a content catalog and a
user-by-month panel. The driver ships TPC-H-style tables instead, so these
views map them onto the same shapes (definitions fixed in FIXTURES.md):

* ``content``  (asset_id, asset_nm, asset_prod, adult_yn)        <- part
* ``activity`` (user_id, strt_dt, asset, use_tms, ct_cl)        <- lineitem x orders x part
* ``panel``    (user_id, p_mt, cancel_yn, tv_hours, ott_yn, last_view_grp,
               agmt_end_seg, voc_yn, voc_cancel_yn)              <- orders x customer

Plan shape at scale: the panel aggregates orders per (customer, month) before
joining customer, so the join sees one row per customer-month instead of one
per order; customer attributes are functions of the unique ``c_custkey``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.months import month_from_timestamp
from tenure.sources.tables import read_table


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    return part.select(
        F.col("p_partkey").alias("asset_id"),
        F.col("p_name").alias("asset_nm"),
        (F.col("p_partkey") % 3).cast("int").alias("asset_prod"),
        (F.col("p_size") == 50).alias("adult_yn"),
    )


def month_bounds(start: int, end: int) -> tuple[str, str]:
    """[first instant of ``start``, first instant after ``end``) as timestamp text."""
    y, m = divmod(end, 100)
    y2, m2 = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{start // 100:04d}-{start % 100:02d}-01 00:00:00", f"{y2:04d}-{m2:02d}-01 00:00:00"


def _in_range(col: str, months: tuple[int, int]):
    lo, hi = month_bounds(*months)
    c = F.col(col)
    return (c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(hi).cast("timestamp_ntz"))


def activity(spark: SparkSession, sf_dir: str, with_month: bool = False,
             months: tuple[int, int] | None = None) -> DataFrame:
    """Viewing log: one row per lineitem, keyed by the ordering customer.

    ``months=(start, end)`` keeps events of those months only, as a range on
    the source timestamp so that it reaches the parquet scan (the month text
    derived from it cannot be pushed down). Same rows as filtering the
    derived month.
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"])
    if months:
        li = li.filter(_in_range("l_shipdate", months))
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    pt = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    ts = F.col("l_shipdate")
    undated = (F.col("l_linenumber") == 7) | ts.isNull()
    # date_format of a non-null timestamp is never null; the coalesce only tells the
    # optimizer so, which lets `strt_dt IS NOT NULL` be decided without formatting.
    strt = F.when(undated, F.lit(None).cast("string")) \
            .otherwise(F.coalesce(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("")))
    cols = [
        F.col("o_custkey").alias("user_id"),
        strt.alias("strt_dt"),
        F.col("l_partkey").alias("asset"),
        F.col("l_quantity").cast("bigint").alias("use_tms"),
        (F.col("p_size") % 16).cast("int").alias("ct_cl"),
    ]
    if with_month:
        # the month of strt_dt, taken from the timestamp fields (no text cut per event)
        cols.append(F.when(undated, F.lit(None).cast("int")).otherwise(month_from_timestamp(ts)).alias("p_mt"))
    return (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
              .join(pt, li.l_partkey == pt.p_partkey, "inner")
              .select(*cols))


def panel(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    """User-by-month panel with the label ``cancel_yn`` and typed attributes.

    ``months=(start, end)`` keeps those panel months, pushed to the scan as a date range.
    """
    od = read_table(spark, sf_dir, "orders",
                    ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])
    if months:
        od = od.filter(_in_range("o_orderdate", months))
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    # year * 100 + month: the same YYYYMM as formatting the date, without text or time-zone work
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int")
    per_month = (od.groupBy(F.col("o_custkey").alias("user_id"), month.alias("p_mt"))
                   .agg(F.max(F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), 1)
                               .otherwise(0)).cast("int").alias("cancel_yn"),
                        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("_cents"),
                        F.count(F.lit(1)).alias("_n")))
    seg = F.col("c_mktsegment")
    key = F.col("user_id")
    return (per_month.join(cu, per_month.user_id == cu.c_custkey, "inner")
            .select(
                "user_id", "p_mt", "cancel_yn",
                (F.col("_cents").cast("double") / (F.col("_n") * 10000000).cast("double")).alias("tv_hours"),
                F.when(seg == "BUILDING", F.lit(None).cast("boolean")).otherwise(seg == "HOUSEHOLD").alias("ott_yn"),
                (key % 6).cast("int").alias("last_view_grp"),
                (key % 8).cast("int").alias("agmt_end_seg"),
                (key % 5 == 0).alias("voc_yn"),
                (key % 10 == 0).alias("voc_cancel_yn"),
            ))


#: A stand-in, in SQL that both engines read, for a user's streaming app flag, which has no column.
APP_USER = "(user_id % 3 = 0)"


# DuckDB text of the same views, inlined as CTEs by every oracle query.
ORACLE_VIEWS = """
content AS (
  SELECT p_partkey AS asset_id, p_name AS asset_nm, CAST(p_partkey % 3 AS INT) AS asset_prod,
         p_size = 50 AS adult_yn
  FROM part),
activity AS (
  SELECT o.o_custkey AS user_id,
         CASE WHEN l.l_linenumber = 7 THEN NULL ELSE strftime(l.l_shipdate, '%Y%m%d%H%M%S') END AS strt_dt,
         l.l_partkey AS asset, CAST(l.l_quantity AS BIGINT) AS use_tms, CAST(p.p_size % 16 AS INT) AS ct_cl
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
panel AS (
  SELECT o.o_custkey AS user_id, CAST(strftime(o.o_orderdate, '%Y%m') AS INT) AS p_mt,
         CAST(MAX(CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS INT) AS cancel_yn,
         CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(COUNT(*) * 10000000 AS DOUBLE) AS tv_hours,
         CASE MIN(c.c_mktsegment) WHEN 'BUILDING' THEN NULL ELSE MIN(c.c_mktsegment) = 'HOUSEHOLD' END AS ott_yn,
         CAST(MIN(c.c_custkey) % 6 AS INT) AS last_view_grp, CAST(MIN(c.c_custkey) % 8 AS INT) AS agmt_end_seg,
         MIN(c.c_custkey) % 5 = 0 AS voc_yn, MIN(c.c_custkey) % 10 = 0 AS voc_cancel_yn
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY o.o_custkey, strftime(o.o_orderdate, '%Y%m'))"""


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a raw text extract (as a CSV load would type it), for profiling and cleaning.

    Flags become Y/N (and yes/no) text, ints become text with '-' for a
    missing contract segment, one category value carries a leading space,
    one column is 90% missing and one is constant.
    """
    p = panel(spark, sf_dir)
    c = F.col
    return p.select(
        c("user_id").cast("string").alias("user_id"),
        c("p_mt").cast("string").alias("p_mt"),
        c("cancel_yn").cast("string").alias("cancel_yn"),
        c("tv_hours"),
        F.when(c("ott_yn"), "Y").when(~c("ott_yn"), "N").alias("ott_yn"),
        F.when(c("voc_yn"), "Y").otherwise("N").alias("voc_yn"),
        F.when(c("voc_cancel_yn"), "yes").otherwise("no").alias("voc_cancel_yn"),
        F.when(c("last_view_grp") == 0, F.lit(" grp0"))
         .otherwise(F.concat(F.lit("grp"), c("last_view_grp").cast("string"))).alias("view_grp"),
        F.when(c("agmt_end_seg") == 7, F.lit("-")).otherwise(c("agmt_end_seg").cast("string")).alias("agmt_seg"),
        F.when(c("user_id") % 10 == 0, F.lit("x")).alias("note"),
        F.lit("tv").alias("src"),
    )


ORACLE_RAW_PANEL = """raw_panel AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(p_mt AS VARCHAR) AS p_mt, CAST(cancel_yn AS VARCHAR) AS cancel_yn,
         tv_hours,
         CASE WHEN ott_yn THEN 'Y' WHEN NOT ott_yn THEN 'N' END AS ott_yn,
         CASE WHEN voc_yn THEN 'Y' ELSE 'N' END AS voc_yn,
         CASE WHEN voc_cancel_yn THEN 'yes' ELSE 'no' END AS voc_cancel_yn,
         CASE WHEN last_view_grp = 0 THEN ' grp0' ELSE 'grp' || CAST(last_view_grp AS VARCHAR) END AS view_grp,
         CASE WHEN agmt_end_seg = 7 THEN '-' ELSE CAST(agmt_end_seg AS VARCHAR) END AS agmt_seg,
         CASE WHEN user_id % 10 = 0 THEN 'x' END AS note,
         'tv' AS src
  FROM panel)"""

# (name, type) of raw_panel, in order
RAW_PANEL_COLUMNS = [("user_id", "VARCHAR"), ("p_mt", "VARCHAR"), ("cancel_yn", "VARCHAR"), ("tv_hours", "DOUBLE"),
                     ("ott_yn", "VARCHAR"), ("voc_yn", "VARCHAR"), ("voc_cancel_yn", "VARCHAR"),
                     ("view_grp", "VARCHAR"), ("agmt_seg", "VARCHAR"), ("note", "VARCHAR"), ("src", "VARCHAR")]
