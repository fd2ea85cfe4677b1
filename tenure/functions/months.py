"""Month (YYYYMM int) and event-time (YYYYMMDDHHMMSS text) helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_of(strt_dt) -> Column:
    """First six characters of the event time as an int month; null stays null."""
    return F.substring(_c(strt_dt).cast("string"), 1, 6).try_cast("int")


def valid_day_key(raw) -> Column:
    """``raw`` (an int read from eight characters) when it is a yyyyMMdd calendar date
    with a year in 1000-9999, else null. Integer arithmetic only."""
    k = _c(raw)
    y, md = F.floor(k / 10000), k % 10000
    m, d = F.floor(md / 100), md % 100
    leap = ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).cast("int")
    days = F.when(m == 2, 28 + leap).otherwise(30 + (m + F.floor(m / 8)) % 2)
    return F.when(k.between(10000101, 99991231) & m.between(1, 12) & (d >= 1) & (d <= days), k)


def _raw_day(strt_dt) -> Column:
    return F.substring(_c(strt_dt).cast("string"), 1, 8).try_cast("int")


def day_key(strt_dt) -> Column:
    """yyyyMMdd of the event time as an int; null unless the first eight characters
    are a calendar date (years 1000-9999).

    No date parsing, and keys sort in date order: aggregate the key (``max``,
    ``min``) and convert only the aggregated value with ``key_date``. Over
    many rows prefer ``with_day_key``, which cuts the text once per row.
    """
    return valid_day_key(_raw_day(strt_dt))


def with_day_key(df: DataFrame, strt_col: str, key_col: str) -> DataFrame:
    """Add ``day_key(strt_col)`` as ``key_col``, reading the eight characters once per row.

    The raw int is its own projection: the optimizer does not inline an
    expression that the validity check references several times, so the
    text is cut and parsed once instead of once per reference.
    """
    raw = f"{key_col}__raw"
    return df.withColumn(raw, _raw_day(strt_col)).withColumn(key_col, valid_day_key(raw)).drop(raw)


def key_date(key) -> Column:
    """Date of a ``day_key`` value (null stays null)."""
    k = _c(key)
    return F.make_date(F.floor(k / 10000).cast("int"), (F.floor(k / 100) % 100).cast("int"), (k % 100).cast("int"))


def day_of(strt_dt) -> Column:
    """Calendar day of the event time (first eight characters, yyyyMMdd); null when not a date."""
    return key_date(day_key(strt_dt))


def last_day_of(strt_dt) -> Column:
    """Aggregate: latest event day (max over the int keys, one date conversion per group)."""
    return key_date(F.max(day_key(strt_dt)))


def month_from_timestamp(ts) -> Column:
    """YYYYMM of a timestamp as int (arithmetic on the fields, no formatting)."""
    c = _c(ts)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def prev_month(p_mt) -> Column:
    """Calendar month before ``p_mt``: January steps back to December of the previous year."""
    m = _c(p_mt)
    return F.when(m % 100 == 1, m - 89).otherwise(m - 1)


def next_month(p_mt) -> Column:
    """Calendar month after ``p_mt`` (inverse of ``prev_month``)."""
    m = _c(p_mt)
    return F.when(m % 100 == 12, m + 89).otherwise(m + 1)


def month_label(p_mt) -> Column:
    """``YYYY-MM`` label for an int month."""
    s = _c(p_mt).cast("string")
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2))


def valid_month(p_mt) -> Column:
    """True when the last two digits are a month number 1..12."""
    mm = F.substring(_c(p_mt).cast("string"), -2, 2).try_cast("int")
    return mm.between(1, 12)


def month_end(p_mt) -> Column:
    """Last calendar day of an int month (as-of date for month-scoped recency)."""
    first = F.try_to_timestamp(_c(p_mt).cast("string"), F.lit("yyyyMM")).cast("date")
    return F.last_day(first)
