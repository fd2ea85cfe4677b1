"""One registered query per operator, with its production parameters, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import alignment, ftrl, jaccard, langid, logratio, lshforest, mixing, multiindex, packing, sharding, urlfilter, warc, whitening
from tenure.llm.shared import fold_of, package_on_workers, table, written
from tenure.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_warc": warc.ORACLE, "op9_url_filter": urlfilter.ORACLE, "op10_mixing": mixing.ORACLE}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        package_on_workers(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = langid.predict_languages(docs.select("doc_id", "text"), langid.learn(docs))
    return got.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", "margin")


@query
def op3_warc(spark, sf_dir):
    path = f"{ensure_checkpoint_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    pages = warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = written(warc.read_archives(spark, path).drop("payload"), "warc-read")
    found = {r["kind"]: r["n"] for r in read.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # records and gaps
    if found.get("record", 0) != pages or found.get("gap"):
        raise RuntimeError(f"{pages} pages were written, but {found} read back from {path}")
    return read.select(warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_id(F.col("refers_to")).alias("refers_to"))


@query
def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query
def op5_sharding(spark, sf_dir):
    return sharding.interleave(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])


@query
def op6_quality_rules(spark, sf_dir):
    got = logratio.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", *logratio.OUTPUTS, "base_failed", "kept", "score")


@query
def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = ftrl.score(docs, ftrl.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_ann_forest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return lshforest.nearest(rows, rows.where("vec_id % 100 = 0"))


@query
def op9_url_filter(spark, sf_dir):
    got = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return got.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")


@query
def op10_mixing(spark, sf_dir):
    got = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("doc_id", "n_tokens", "topic", F.round("gain", 9).alias("gain"), F.round("probability", 9).alias("probability"), "sampled")


@query
def op11_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op12_embedding_dedup(spark, sf_dir):
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
