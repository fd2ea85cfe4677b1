"""Operator 5, sharding by proportional stratified interleaving. DataFrame functions only.

Within each source rows are shuffled by a seeded hash and ranked; rank r of n has the fractional rank
(r + 1/2) / n. All rows sorted by fractional rank (ties: source, nulls first) are cut into shards of equal row
counts, so every shard has each source in its share of the whole. The law that holds is ``rows``: shard counts
are at most one apart.

No task sorts a whole source or the whole table. Ranks come from hash buckets (``shared.numbered``), and a
row's place in the whole order is the exact count of rows in earlier slices of the fractional rank, which
follows from the sources' row counts alone, plus its place in its slice. A source may hold any share of the rows.

Defined cases: null text has size 8 and crc32 0; null sources are one stratum; rows alike in id, text and source
take places in any order; an empty table gives no rows; fewer rows than shards leave shards empty. Input columns
named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.shared import hex_int, numbered, seeded_hex

SHARDS = 24
SEED = 5
OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Slices are summed in chunks of so many, then the chunks.
_CHUNK = 4096


def _rows_before(strata: DataFrame, slices: int) -> DataFrame:
    """_slice, _before: the rows of all strata (``_n``) in earlier slices, for every slice that has rows.

    A stratum of fewer rows than slices gives a row per row it has, a larger one a row per slice: never more than
    the table has rows, however many strata there are, and summed before they are shuffled.
    """
    sparse = (strata.where(F.col("_n") < slices).select("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_r"))
              .select(F.expr(f"(2 * _r + 1) * {slices} div (2 * _n)").alias("_slice"), F.lit(1).cast("long").alias("_k")))
    # Rows of a stratum of n before slice b: ranks r with (2r + 1) * slices < 2 b n, that is floor(ceil(2 b n / slices) / 2).
    ahead = lambda b: f"((2 * {b} * _n + {slices - 1}) div {slices}) div 2"
    dense = (strata.where(F.col("_n") >= slices).select("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("_slice"))
             .select("_slice", F.expr(f"{ahead('(_slice + 1)')} - {ahead('_slice')}").alias("_k")))
    counts = sparse.unionByName(dense).groupBy("_slice").agg(F.sum("_k").alias("_k")).withColumn("_chunk", F.expr(f"_slice div {_CHUNK}"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.groupBy("_chunk").agg(F.sum("_k").alias("_t")).select("_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("_in", F.coalesce(F.sum("_k").over(inside), F.lit(0))).join(chunks, "_chunk")
            .select("_slice", (F.col("_base") + F.col("_in")).alias("_before")))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source", text: str = "text",
               rows_per_slice: int = 20_000, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all) of every row with size, text_crc32, law, shard, slot and grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    rows = docs.withColumns({"_size": (F.octet_length(body) + 8).cast("long"), "_crc": F.crc32(body.cast("binary")), "_stratum": F.col(stratum).cast("string")})
    rows = rows.withColumn("_x", seeded_hex(seed, "doc_id", "_crc", "_size")).withColumn("_h", hex_int(F.col("_x"), 1, 8))
    rows = rows.select(*keep, "_size", "_crc", "_stratum", "_x", "_h")
    strata = rows.groupBy("_stratum").agg(F.count("*").alias("_n"))
    n = strata.agg(F.sum("_n")).first()[0] or 0
    slices = max(16, n // rows_per_slice)
    ranked = numbered(rows, ["_stratum"], "_h", ["_x"], "_rank", rows_per_slice)
    ranked = ranked.withColumns({"_frac": (F.col("_rank") + 0.5) / F.col("_total"), "_slice": F.expr(f"(2 * _rank + 1) * {slices} div (2 * _total)")})
    before = _rows_before(strata, slices)
    in_slice = Window.partitionBy("_slice").orderBy("_frac", F.col("_stratum").asc_nulls_first(), "_rank")
    placed = (ranked.withColumn("_row", F.row_number().over(in_slice) - 1).join(before, "_slice")
              .withColumn("_place", (F.col("_before") + F.col("_row")).cast("long")))
    placed = placed.withColumn("shard", F.expr(f"CAST(_place * {shards} div {max(n, 1)} AS INT)"))
    return placed.select(*keep, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
                         F.expr(f"_place - ((CAST(shard AS LONG) * {n} + {shards - 1}) div {shards})").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
