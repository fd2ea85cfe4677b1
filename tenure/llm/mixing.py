"""Operator 10, mixing by iterative proportional fitting. DataFrame functions only.

Tokens (words plus one end mark per document) are summed per cell of source, language and topic. Raking scales
the cells to one margin's target after another, ``passes`` times over. A margin's targets are its own shares
raised to ``power`` and normed, or given shares, normed over the values that occur (a value without a share gets
none). A cell's gain is its raked over its own weight; documents are kept with probability ``min(1, rate * gain)``,
by a seeded hash of the id.

The rate is calibrated so that ``share`` of the tokens is expected to be kept, whatever cells there are: a cell that
would need more than all its documents is kept whole and the others share the rest, so a rare document does not thin
out the sample; its margins then stay below target. With ``tolerance`` raking goes on beyond ``passes`` until every
margin is that close to its target or no longer comes closer; both shortfalls are logged.

The tables carry no topic, so by default a document's length class stands for it (``topic`` column: null).

Defined cases: null source, language or topic is a value of its own; null and empty texts are documents of one
token; repeated rows share their id's draw; a null id draws as its own text; an empty table gives no rows.
The raking runs over cells only, in one task: the distinct combinations of source, language and topic, about 100 bytes
each, so sources should number millions at most; documents are never gathered. Input columns named like an output are
replaced.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.shared import hex_int, seeded_hex, written

POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
PASSES = 8
SEED = 10
#: Of the tokens, what a mixture keeps, and how far a margin may be off its target (relative) in the pipeline.
SHARE = 0.5
TOLERANCE = 0.01
#: Cells up to this many rows are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
MARGINS = ("_source", "_lang", "_topic")
OUTPUTS = ("n_tokens", "topic", "gain", "probability", "sampled")
_log = logging.getLogger(__name__)


def n_tokens(text: Column) -> Column:
    """Words (runs of other than ASCII white space) plus one."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return (F.length(F.translate(gaps, " \t\n\x0b\f\r", "")) + 1).cast("long")


def length_class(tokens: Column) -> Column:
    return F.when(tokens < 100, "brief").when(tokens < 400, "short").when(tokens < 1500, "medium").otherwise("long")


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], passes: int = PASSES) -> DataFrame:
    """Cells (three margins and tokens ``_t``) with ``_w``, the weights raked to the targets.

    The windows run in the single partition of the cells, so no step shuffles.
    """
    cells = cells.coalesce(1)
    whole = Window.partitionBy()
    for margin, spec in zip(MARGINS, (targets["source"], targets["lang"], targets["topic"])):
        mine = Window.partitionBy(margin)
        cells = cells.withColumn("_m", F.sum("_t").over(mine).cast("double")).withColumn("_all", F.sum("_t").over(whole).cast("double"))
        cells = cells.withColumn("_want", _target_share(margin, spec)).withColumn("_norm", F.sum(F.col("_want") * F.col("_t") / F.col("_m")).over(whole))
        cells = cells.withColumn(f"_to{margin}", F.when(F.col("_norm") > 0, F.col("_want") * F.col("_all") / F.col("_norm")).otherwise(F.col("_m")))
    return _scaled(cells.withColumn("_w", F.col("_t").cast("double")), passes)


def _scaled(cells: DataFrame, passes: int) -> DataFrame:
    for _ in range(passes):
        for margin in MARGINS:
            cells = cells.withColumn("_s", F.sum("_w").over(Window.partitionBy(margin)))
            cells = cells.withColumn("_w", F.when(F.col("_s") > 0, F.col("_w") * F.col(f"_to{margin}") / F.col("_s")).otherwise(0.0))
    return cells


def margin_gap(cells: DataFrame) -> float:
    """The largest relative distance of any margin's weight from its target."""
    sums = cells.select("_w", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v"), F.col(f"_to{m}").alias("to")) for m in MARGINS])).alias("_x"))
    sums = sums.where("_x.to > 0").groupBy("_x.m", "_x.v").agg(F.sum("_w").alias("w"), F.max("_x.to").alias("to"))
    return sums.agg(F.max(F.abs(F.col("w") / F.col("to") - 1))).first()[0] or 0.0


def raked_cells(cells: DataFrame, targets: dict[str, float | dict[str, float]], passes: int = PASSES, tolerance: float | None = None) -> DataFrame:
    """``rake``, written; with a tolerance ``passes`` more at a time while a margin is off and still comes closer."""
    keep = [*MARGINS, "_t", "_w", *[f"_to{m}" for m in MARGINS]]
    cells = written(rake(cells, targets, passes).select(*keep), "cells")
    if tolerance is None:
        return cells
    gap, before = margin_gap(cells), float("inf")
    while tolerance < gap < 0.99 * before:
        cells = written(_scaled(cells.coalesce(1), passes).select(*keep), "cells")
        gap, before = margin_gap(cells), gap
    if gap > tolerance:
        _log.warning("the targets cannot all be met: a margin stays %.1f %% off", 100 * gap)
    return cells


def keep_rate(cells: DataFrame, share: float = SHARE) -> float:
    """What gains are multiplied by, so that ``share`` of the tokens is expected to be kept.

    From the largest gain down, the first cell that is not kept whole when it and all smaller ones share what is
    left to keep. Where cells with a gain hold fewer tokens than that, all of those are kept. Runs over the cells, in
    one partition.
    """
    gains = cells.select("_t", "_w", (F.col("_w") / F.col("_t")).alias("_g")).where("_g > 0").coalesce(1)
    total = cells.agg(F.sum("_t")).first()[0]
    if not total:
        return 1.0
    down = Window.partitionBy().orderBy(F.desc("_g"), "_t")
    before = F.coalesce(F.sum("_t").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rate = (F.lit(share) * total - before) / F.sum("_w").over(down.rowsBetween(0, Window.unboundedFollowing))
    fits = F.col("_r") * F.col("_g") <= 1
    found, least = gains.withColumn("_r", rate).agg(F.max_by(F.when(fits, F.col("_r")), F.when(fits, F.col("_g"))), F.min("_g")).first()
    if least is None:
        return 1.0
    found = found if found is not None else 1.0 / least
    whole = gains.where(F.col("_g") * found > 1).agg(F.count("*"), F.sum("_t")).first()
    if whole[0]:
        _log.warning("%d cells with %.4f %% of the tokens are kept whole, so that the others keep their share", whole[0], 100 * whole[1] / total)
    return found


def _target_share(margin: str, spec: float | dict[str, float]) -> Column:
    if not isinstance(spec, dict):
        return F.pow(F.col("_m") / F.col("_all"), F.lit(float(spec)))
    want = F.lit(0.0)
    for value, share in spec.items():
        want = F.when(F.col(margin).eqNullSafe(F.lit(value)), float(share)).otherwise(want)
    return want


def mix_sources(docs: DataFrame, targets: dict[str, float | dict[str, float]] | None = None, passes: int = PASSES, share: float = SHARE,
                seed: int = SEED, topic: str | None = None, carry: list[str] | None = None, tolerance: float | None = None) -> DataFrame:
    """``carry`` columns (default: all) of every row with n_tokens, topic, gain, probability and sampled."""
    keep = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    draw = hex_int(seeded_hex(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), 1, 12) / float(1 << 48)
    rows = docs.withColumn("_t", n_tokens(F.col("text"))).withColumn("_u", draw)
    rows = rows.withColumns({"_source": F.col("source"), "_lang": F.col("lang"), "_topic": F.col(topic).cast("string") if topic else length_class(F.col("_t"))})
    cells = raked_cells(rows.groupBy(*MARGINS).agg(F.sum("_t").alias("_t")), targets or POWERS, passes, tolerance)
    gains = cells.select(*[F.col(m).alias(f"c{m}") for m in MARGINS], (F.col("_w") / F.col("_t")).alias("_g"))
    factor = keep_rate(cells, share)
    if cells.count() <= BROADCAST_CELLS:
        gains = F.broadcast(gains)
    match = [F.col(m).eqNullSafe(F.col(f"c{m}")) for m in MARGINS]
    p = F.least(F.col("_g") * F.lit(factor), F.lit(1.0))
    return (rows.select(*keep, "_t", "_u", *MARGINS).join(gains, match[0] & match[1] & match[2])
            .select(*keep, F.col("_t").alias("n_tokens"), F.col("_topic").alias("topic"), F.col("_g").alias("gain"), p.alias("probability"), (F.col("_u") < p).alias("sampled")))


def _sql() -> str:
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1"
    steps = [f"""d0 AS (SELECT *, CAST({words} AS BIGINT) AS t FROM documents)""",
             """d AS (SELECT *, CASE WHEN t < 100 THEN 'brief' WHEN t < 400 THEN 'short' WHEN t < 1500 THEN 'medium' ELSE 'long' END AS topic,
  CAST(('0x' || substr(md5('10|' || coalesce(CAST(doc_id AS VARCHAR), text, '~')), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM d0)""",
             "c0 AS (SELECT source, lang, topic, CAST(sum(t) AS DOUBLE) AS t FROM d GROUP BY 1, 2, 3)",
             "c1 AS (SELECT *, " + ", ".join(f"pow(sum(t) OVER (PARTITION BY {m}) / sum(t) OVER (), {POWERS[m]}) AS want_{m}, sum(t) OVER (PARTITION BY {m}) AS m_{m}"
                                              for m in POWERS) + " FROM c0)",
             "w0 AS (SELECT source, lang, topic, t, t AS w, " + ", ".join(
                 f"want_{m} * sum(t) OVER () / sum(want_{m} * t / m_{m}) OVER () AS to_{m}" for m in POWERS) + " FROM c1)"]
    keep = "source, lang, topic, t, to_source, to_lang, to_topic"
    k = 0
    for _ in range(PASSES):
        for m in POWERS:
            k += 1
            steps.append(f"w{k} AS (SELECT {keep}, w * to_{m} / sum(w) OVER (PARTITION BY {m}) AS w FROM w{k - 1})")
    steps += [f"g AS (SELECT source, lang, topic, t, w, w / t AS g FROM w{k})",
              f"""r AS (SELECT g, ({SHARE} * (SELECT sum(t) FROM g) - coalesce(sum(t) OVER (ORDER BY g DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY g DESC, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM g WHERE g > 0)""",
              "f AS (SELECT coalesce((SELECT max_by(rate, g) FROM r WHERE rate * g <= 1), 1 / (SELECT min(g) FROM r)) AS rate)"]
    return "WITH " + ",\n".join(steps) + """
SELECT d.doc_id, d.t AS n_tokens, d.topic, round(g.g, 9) AS gain, round(least(g.g * f.rate, 1), 9) AS probability, d.u < least(g.g * f.rate, 1) AS sampled
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.lang IS NOT DISTINCT FROM g.lang AND d.topic = g.topic CROSS JOIN f"""


ORACLE = _sql()
