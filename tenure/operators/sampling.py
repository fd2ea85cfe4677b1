"""Seeded, partition-independent sampling and splits.

Every draw is a function of a row's key and a seed, never of its partition
or position: the same rows come out under 1 or 1,000 partitions and after a
task retry. The hash is portable (same value in Spark and in SQL engines):
the first 8 hex digits of ``md5(key || seed)`` read as a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.operators.ranking import first_rows, global_rank


def _key_text(key_cols: Sequence[str]) -> Column:
    cols = [F.col(c).cast("string") for c in key_cols]
    return cols[0] if len(cols) == 1 else F.concat_ws("|", *cols)


def hash32(key_cols: Sequence[str] | str, seed: int | str) -> Column:
    """Unsigned 32-bit portable hash of the key text followed by the seed text."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    digest = F.md5(F.concat(_key_text(keys), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key_cols: Sequence[str] | str, seed: int | str, modulo: int = 10000) -> Column:
    return hash32(key_cols, seed) % modulo


def hash32_sql(key_sql: str, seed: int | str) -> str:
    return f"CAST(('0x' || substr(md5({key_sql} || '{seed}'), 1, 8)) AS BIGINT)"


def class_ratio_thresholds(total: int, class_counts: dict[int, int], sample_pct: float,
                           ratios: dict[int, float], modulo: int = 10000) -> dict[int, int]:
    """Per-class hash thresholds that give ``ratios`` of a ``sample_pct`` sample."""
    target_total = int(total * sample_pct)
    out = {}
    for cls, share in ratios.items():
        target = int(target_total * share)
        have = class_counts.get(cls, 0)
        out[cls] = int((target / have) * modulo) if have else 0
    return out


def class_ratio_sample(df: DataFrame, label_col: str, key_col: str, sample_pct: float = 0.05,
                       ratios: dict[int, float] | None = None, seed: int = 42,
                       modulo: int = 10000) -> DataFrame:
    """L2: keep a row when its key's hash falls under its class threshold.

    The class counts are one small aggregate (two numbers reach the driver);
    the thresholds act on keys, so all rows of a user are kept or dropped
    together.
    """
    ratios = ratios or {0: 0.80, 1: 0.20}
    counts = {int(r[label_col]): int(r["n"]) for r in
              df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect() if r[label_col] is not None}
    total = df.count() if None in counts else sum(counts.values())
    th = class_ratio_thresholds(total, counts, sample_pct, ratios, modulo)
    h = hash_bucket(key_col, seed, modulo)
    cond = F.lit(False)
    for cls, t in th.items():
        cond = cond | ((F.col(label_col) == cls) & (h < t))
    return df.filter(cond)


def seeded_sample(df: DataFrame, n: int | None, key_cols: Sequence[str], seed: int = 42,
                  prefix_bits: int = 16) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by hash order (ties by key).

    ``n=None`` returns every row. The limit is the feature here. A plain
    ``orderBy().limit(n)`` keeps the top n of every partition and merges them
    in one task (up to n x partitions rows). Instead the rows are first
    counted per hash prefix (at most ``2**prefix_bits`` counts, running-summed
    in Spark); only rows up to the prefix where the count reaches n go into
    the top-n, so the merge sees about n + rows / 2**prefix_bits rows.
    """
    if n is None:
        return df
    keys = list(key_cols)
    hashed = df.withColumn("_h", hash32(keys, seed))
    prefix = (F.col("_h") / float(2 ** (32 - prefix_bits))).cast("bigint")
    counts = hashed.groupBy(prefix.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    # one row per prefix: a bounded table, so a single ordered window over it is fine
    upto = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.withColumn("_cum", upto).filter(F.col("_cum") >= int(n)).agg(F.min("_b")).first()[0]
    # a null key hashes to null and sorts first, so null prefixes always stay candidates
    cand = hashed if cut is None else hashed.filter(prefix.isNull() | (prefix <= cut))
    return cand.orderBy(F.col("_h"), *[F.col(k) for k in keys]).limit(int(n)).drop("_h")


def rule_samples(df: DataFrame, groups: Sequence[tuple[str, Column, int, int]], key_cols: Sequence[str],
                 group_col: str = "grp") -> DataFrame:
    """Of each rule (name, condition, n, seed) its first ``n`` rows by hash order (ties by key), in one plan.

    A row counts in every rule it meets. Each task keeps at most the largest ``n`` rows per rule before the
    shuffle, so ``n`` is meant to be small (a few rows to look at).
    """
    keys = list(key_cols)
    met = F.array(*[F.when(cond, F.struct(F.lit(name).alias("g"), hash32(keys, seed).alias("h"), F.lit(n).alias("n")))
                    for name, cond, n, seed in groups])
    tagged = (df.withColumn("_met", F.explode(F.array_compact(met)))
                .withColumns({group_col: F.col("_met.g"), "_h": F.col("_met.h"), "_n": F.col("_met.n")}))
    first = first_rows(tagged, [group_col], [F.col("_h"), *[F.col(k) for k in keys]], max(n for _, _, n, _ in groups), "_r")
    return first.filter(F.col("_r") <= F.col("_n")).drop("_met", "_h", "_n", "_r")


def stratified_split(df: DataFrame, label_col: str | None, key_cols: Sequence[str], val_frac: float = 0.2,
                     seed: int = 42, split_col: str = "is_val") -> DataFrame:
    """Per class, the first ``ceil(val_frac * n_class)`` rows in hash order are validation.

    ``label_col=None`` splits without stratification. Ranks come from the
    two-pass global rank, so no class is gathered into one task.
    """
    keys = list(key_cols)
    groups = [label_col] if label_col else []
    ranked = global_rank(df.withColumn("_h", hash32(keys, seed)), ["_h", *keys], group_cols=groups,
                         rank_col="_r", count_col="_n")
    return ranked.withColumn(split_col, F.col("_r") <= F.ceil(F.col("_n") * F.lit(val_frac))) \
                 .drop("_h", "_r", "_n")


def stratified_folds(df: DataFrame, label_col: str | None, key_cols: Sequence[str], k: int = 5,
                     seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Fold 1..k dealt round-robin down each class's hash order (sizes differ by <= 1)."""
    keys = list(key_cols)
    groups = [label_col] if label_col else []
    ranked = global_rank(df.withColumn("_h", hash32(keys, seed)), ["_h", *keys], group_cols=groups,
                         rank_col="_r")
    return ranked.withColumn(fold_col, ((F.col("_r") - 1) % k + 1).cast("int")).drop("_h", "_r")


def split_and_folds(df: DataFrame, label_col: str | None, key_cols: Sequence[str], val_frac: float = 0.2, k: int = 5, seed: int = 42,
                    split_col: str = "is_val", fold_col: str = "fold") -> DataFrame:
    """L5 and L6 of the same order from one global rank: ``stratified_folds(stratified_split(df, ..), ..)``."""
    keys = list(key_cols)
    ranked = global_rank(df.withColumn("_h", hash32(keys, seed)), ["_h", *keys], group_cols=[label_col] if label_col else [],
                         rank_col="_r", count_col="_n")
    return ranked.withColumn(split_col, F.col("_r") <= F.ceil(F.col("_n") * F.lit(val_frac))) \
                 .withColumn(fold_col, ((F.col("_r") - 1) % k + 1).cast("int")).drop("_h", "_r", "_n")
