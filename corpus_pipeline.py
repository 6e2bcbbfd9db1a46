"""The corpus pipeline: five stages from `documents` to a weighted training mix, each one of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import decontam, line_dedup, quality, shingles, simhash
from strandgraph.llm.common import written
from strandgraph.llm.components import connected_components
from strandgraph.llm.queries import mixed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more; the others go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_scores(docs, model, name="_score").where("_score >= 0.3").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; one of which nothing is left goes."""
    left = line_dedup.without_lines(docs.select(*COLUMNS), line_dedup.repeated_lines(docs))
    left = left.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_lines_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, rows without one last.

    Fingerprints of 2 or fewer differing bits link, by the operator of op6; near copies whose fingerprints are further apart are
    then found by an exact join, at a five-word Jaccard similarity of 0.8 or more. A group is what either kind of links connects."""
    rows = docs.select(*COLUMNS).withColumn("_own", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_row", F.xxhash64("doc_id", "_own"))
    known = rows.select(F.col("_row").alias("doc_id"), "text")
    links = [found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for found in (simhash.near_duplicates(known), shingles.near_duplicates(known))]
    group = connected_components(links[0].unionByName(links[1]))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_own", "_row", "n")
    each = rows.groupBy("_row", "doc_id", "_own").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(group.select(F.col("node").alias("_row"), "component").hint("merge"), "_row", "left")
    first = written(each.groupBy(F.coalesce("component", "_row").alias("group")).agg(F.min(order).alias("r")).select("r._row", "r.n"))
    one = rows.join(first.where("n = 1"), "_row", "left_semi").select(*COLUMNS)
    # Of rows equal in doc_id and text, the least by the other columns.
    several = rows.join(first.where("n > 1"), "_row", "left_semi")
    least = several.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return one.unionByName(least)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark."""
    hit = decontam.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = written(hit.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    rows = docs.select(*COLUMNS).withColumn("_own", F.xxhash64("text"))
    return rows.join(hit, (F.col("_own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: each document once for each epoch that takes it."""
    out = mixed(docs)
    return out.select(*COLUMNS, "level_domain", "n_tokens", "epoch", "leaf_budget")


STAGES = [("quality classifier", good), ("line dedup", lines), ("SimHash near-dedup", distinct), ("benchmark decontamination", clean), ("mixing to target weights", mix)]
#: SQL can express neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
