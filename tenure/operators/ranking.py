"""Global ranks, rank buckets, shares and running sums.

A global order (rank of every user, cumulative counts down a score list) is
the one place a naive plan collapses into a single task. Here it is two
passes instead: range-partition on the order (plus a unique key, so equal
values do not pile into one partition), number rows inside each partition,
then add the row counts of all earlier partitions. Only the per-partition
counts (one row per partition and group) are combined with a window.

The range bounds are sampled from the input, so two evaluations of the same
plan can partition differently. The partitioned rows are therefore written
once to the shared checkpoint folder (``durable=True``, the default) and both
passes read that copy; a lost executor re-reads it instead of re-sampling.
The order columns should form a total order (end with a unique key) so that
ranks are reproducible run to run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.session import ensure_checkpoint_dir

#: Offsets (a row per range partition and group) up to this many rows are broadcast.
MAX_BROADCAST_OFFSETS = 200_000


def _order_exprs(order_cols: Sequence, descending: Sequence[bool] | None) -> list[Column]:
    out = []
    for i, c in enumerate(order_cols):
        col = F.col(c) if isinstance(c, str) else c
        desc = bool(descending[i]) if descending else False
        out.append(col.desc_nulls_last() if desc else col.asc_nulls_first())
    return out


def _partitioned(df: DataFrame, group_cols: Sequence[str], order: list[Column],
                 num_partitions: int | None, durable: bool) -> DataFrame:
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + order
    # without a given number Spark merges neighbouring ranges of few rows, so that small inputs take few tasks
    dealt = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    parted = (dealt.sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    if not durable:
        return parted
    # not cached first, as a cached plan keeps all its ranges; only the sort of the dealt rows runs twice
    ensure_checkpoint_dir(df.sparkSession)
    return parted.checkpoint(eager=True)


def global_rank(df: DataFrame, order_cols: Sequence, group_cols: Sequence[str] = (),
                descending: Sequence[bool] | None = None, rank_col: str = "rank",
                count_col: str | None = None, num_partitions: int | None = None,
                durable: bool = True) -> DataFrame:
    """1-based position of every row in ``order_cols`` order, restarting per ``group_cols``.

    Equivalent to ``row_number() OVER (PARTITION BY groups ORDER BY order)``
    without sending a group to one task. ``count_col`` also attaches the
    group's row count (taken from the per-partition counts, not a window
    over the rows).
    """
    group_cols = list(group_cols)
    order = _order_exprs(order_cols, descending)
    parted = _partitioned(df, group_cols, order, num_partitions, durable)
    counts = parted.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"),
                                                     F.min("_mid").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    if count_col:
        offsets = offsets.withColumn(count_col, F.sum("_cnt").over(Window.partitionBy(*group_cols)))
    offsets = offsets.drop("_cnt")
    if not group_cols or durable:
        offsets = _offsets_side(offsets, group_cols)
    out = parted.join(offsets, ["_pid", *group_cols], "inner")
    return out.withColumn(rank_col, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1) \
              .drop("_pid", "_mid", "_first", "_off")


def running_sums(df: DataFrame, order_cols: Sequence, sum_cols: Sequence[str],
                 group_cols: Sequence[str] = (), descending: Sequence[bool] | None = None,
                 prefix: str = "cum_", total_prefix: str | None = None,
                 num_partitions: int | None = None, durable: bool = True) -> DataFrame:
    """Inclusive cumulative sums of ``sum_cols`` down a global order, restarting per group.

    Rows are range-partitioned on (groups, order); each (partition, group)
    computes its local running sums and adds the totals of the same group in
    earlier partitions. ``total_prefix`` also attaches each group's totals.
    """
    group_cols = list(group_cols)
    order = _order_exprs(order_cols, descending)
    parted = _partitioned(df, group_cols, order, num_partitions, durable)
    totals = parted.groupBy("_pid", *group_cols).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    w_before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum(f"_tot_{c}").over(w_before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols]
    if total_prefix:
        offs += [F.sum(f"_tot_{c}").over(Window.partitionBy(*group_cols)).alias(total_prefix + c) for c in sum_cols]
    offsets = totals.select("_pid", *group_cols, *offs)
    if not group_cols or durable:
        offsets = _offsets_side(offsets, group_cols)
    w_local = Window.partitionBy("_pid", *group_cols).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = parted
    for c in sum_cols:
        local = local.withColumn(f"_loc_{c}", F.sum(c).over(w_local))
    out = local.join(offsets, ["_pid", *group_cols], "inner")
    for c in sum_cols:
        out = out.withColumn(prefix + c, F.col(f"_off_{c}") + F.col(f"_loc_{c}"))
    return out.drop("_pid", "_mid", *[f"_loc_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols])


def first_rows(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based place.

    Spark keeps the first ``k`` of a group in every task before the shuffle, so a
    group sends ``k`` rows per task however large it is.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def _offsets_side(offsets: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Broadcast the per-partition offsets where they are few, so that the rows are not dealt out again.

    Without groups there is one row per range partition. With groups their number is counted first.
    """
    if not group_cols or offsets.count() <= MAX_BROADCAST_OFFSETS:
        return F.broadcast(offsets)
    return offsets


def rank_bucket(rank: Column | str, n: Column | str, q: int) -> Column:
    """Pandas ``qcut(rank(method='first'), q)`` label (1..q) from a 1-based rank r of n.

    Bucket = ceil((r-1)*q/(n-1)), at least 1: the bins are the q equal
    intervals of the rank range [1, n]. Differs from ``ntile`` (which deals
    remainders to the first buckets). n = 1 gives bucket 1.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    cnt = F.col(n) if isinstance(n, str) else n
    b = F.floor(((r - 1) * q + cnt - 2) / (cnt - 1))
    return F.when(cnt <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), b)).cast("int")


def rank_buckets(df: DataFrame, value_col: str, key_col: str, q: int, bucket_col: str,
                 fill: float | None = None, durable: bool = True) -> DataFrame:
    """Attach a rank-first quantile bucket of ``value_col`` (ties ordered by ``key_col``).

    ``fill`` replaces nulls before ranking (pandas ``fillna``); otherwise
    nulls rank first.
    """
    v = F.coalesce(F.col(value_col), F.lit(fill)) if fill is not None else F.col(value_col)
    ranked = global_rank(df.withColumn("_rv", v), ["_rv", key_col], rank_col="_r", count_col="_n",
                         durable=durable)
    return ranked.withColumn(bucket_col, rank_bucket("_r", "_n", q)).drop("_rv", "_r", "_n")


def share_within(df: DataFrame, value_col: str, group_cols: Sequence[str], share_col: str) -> DataFrame:
    """Value / total of its group.

    Group totals come from a grouped aggregate joined back on the group keys
    (one row per group, broadcast by AQE when small) rather than a window,
    which would put each group, however large, into one task.
    """
    totals = df.groupBy(*group_cols).agg(F.sum(value_col).alias("_group_total"))
    return df.join(totals, list(group_cols), "inner") \
             .withColumn(share_col, F.col(value_col).cast("double") / F.col("_group_total")).drop("_group_total")


def multi_rank_buckets(df: DataFrame, key_col: str, specs: dict[str, tuple[Column, int]],
                       durable: bool = True) -> DataFrame:
    """Several rank-first quantile buckets in one ranking pass.

    ``specs`` maps output column -> (value expression, q). Each distinct value
    expression is ranked once (ties by ``key_col``); the metrics travel as one
    long (metric, value, key) table through a single range partitioning, and
    the buckets return to one row per key. ``key_col`` must be unique in ``df``.
    """
    exprs: dict[str, Column] = {}
    metric_of: dict[str, str] = {}
    for out_col, (expr, _q) in specs.items():
        name = next((m for m, e in exprs.items() if str(e) == str(expr)), None)
        if name is None:
            name = f"m{len(exprs)}"
            exprs[name] = expr
        metric_of[out_col] = name
    items = F.array(*[F.struct(F.lit(m).alias("_metric"), e.cast("double").alias("_v")) for m, e in exprs.items()])
    long = df.select(F.col(key_col), F.explode(items).alias("_it")).select(key_col, "_it._metric", "_it._v")
    ranked = global_rank(long, ["_v", key_col], group_cols=["_metric"], rank_col="_r", count_col="_n",
                         durable=durable)
    wide = ranked.groupBy(key_col).agg(*[
        F.max(F.when(F.col("_metric") == metric_of[c], rank_bucket("_r", "_n", q))).alias(c)
        for c, (_e, q) in specs.items()])
    return df.join(wide, key_col, "inner")
