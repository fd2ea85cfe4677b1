"""The streaming form of the monthly aggregate equals the batch result, and a rerun resumes."""

import __spark_entry__ as entry

from given_tables import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.select("user_id", "p_mt", "vod_view_cnt", "vod_use_tms_sum").collect())


def test_stream_equals_batch(spark):
    qs = entry.queries()
    batch = _rows(qs["a5_monthly_activity"](spark, SF001))
    stream = _rows(qs["a5_streaming_monthly"](spark, SF001))
    assert batch == stream and len(batch) > 0


def test_late_rows_repeats_and_closed_windows(spark, tmp_path):
    """Late rows count while their window is open, repeats count once, windows appear once and only when closed."""
    from datetime import datetime, timedelta

    from tenure.streaming.daily import SCHEMA, daily_stream, daily_windows, read_windows
    day = lambda d, h=12: datetime(2024, 1, d, h)
    batches = [[(1, day(1), 1, "a", 1.5), (2, day(1, 13), 1, "a", None), (3, day(2), 2, "b", 2.0)],
               [(4, day(3), 1, "a", 1.0), (1, day(1), 1, "a", 1.5), (5, day(1, 23), 3, "a", 0.25)],  # a repeat, and a late row of an open day
               [(6, day(7), 1, "a", 3.0)],  # closes the days up to the 4th
               [(7, day(1), 9, "a", 100.0), (8, day(6), 9, "b", 1.0)],  # too late; late but open
               [(9, day(20), 1, "a", 1.0)]]
    src, target, ckpt = (f"file:{tmp_path}/{n}" for n in ("src", "target", "ckpt"))
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        daily_stream(spark, src, target, ckpt).awaitTermination()
        seen.append(sorted((r.day.day, r.event_type, r.n_events, r.n_valued, r.value_cents) for r in read_windows(spark, target).collect()))
    assert seen[0] == seen[1] == []
    assert seen[2] == [(1, "a", 3, 2, 175), (2, "b", 1, 1, 200), (3, "a", 1, 1, 100)] == seen[3]
    assert seen[4] == sorted([*seen[2], (6, "b", 1, 1, 100), (7, "a", 1, 1, 300)])
    kept = [r for b in batches for r in b if r[0] not in (7, 9)]
    batch = daily_windows(spark.createDataFrame(list(dict.fromkeys(kept)), SCHEMA)).collect()
    assert sorted((r.day.day, r.event_type, r.n_events, r.n_valued, r.value_cents) for r in batch) == seen[4]
    _ = timedelta


def test_a_replayed_batch_replaces_its_own_part(spark, tmp_path):
    from tenure.streaming.monthly import monthly_stream, read_monthly
    src, target = f"file:{tmp_path}/src", f"file:{tmp_path}/target"
    rows = spark.createDataFrame([(1, "20240105000000", 10), (1, "20240107000000", 5), (2, "20240201000000", None), (2, None, 7), (3, "20240301000000", 1)], "user_id long, strt_dt string, use_tms long")
    rows.coalesce(1).write.parquet(src)
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    for ckpt in ("one", "two"):  # a new checkpoint replays the batch under the same id
        monthly_stream(spark, src, rows.schema, users, 202401, 202412, target, f"file:{tmp_path}/{ckpt}").awaitTermination()
        assert _rows(read_monthly(spark, target)) == [(1, 202401, 2, 15), (2, 202402, 1, 0)]
    rows.where("user_id = 1").coalesce(1).write.mode("append").parquet(src)
    monthly_stream(spark, src, rows.schema, users, 202401, 202412, target, f"file:{tmp_path}/two").awaitTermination()
    assert _rows(read_monthly(spark, target)) == [(1, 202401, 4, 30), (2, 202402, 1, 0)]
