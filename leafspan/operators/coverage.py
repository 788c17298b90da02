"""Pages that no leaf section covers, and what fills them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def missing_pages(leaves: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, page_no) of pages outside of every leaf's range."""
    pages = totals.select("doc_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page_no"))
    covered = leaves.select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    return pages.join(covered, ["doc_id", "page_no"], "left_anti")


def gaps(missing: DataFrame) -> DataFrame:
    """(doc_id, gap_start, gap_end): runs of missing pages."""
    island = F.col("page_no") - F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))
    return missing.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page_no").alias("gap_start"), F.max("page_no").alias("gap_end")).drop("island")


def coverage(leaves: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, total_pages, covered, missing, pct) of every document; nought pages give 0 per cent."""
    lost = missing_pages(leaves, totals).groupBy("doc_id").agg(F.count("*").alias("missing"))
    df = totals.join(lost, "doc_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    df = df.withColumn("covered", F.col("total_pages") - F.col("missing"))
    return df.withColumn("pct", F.when(F.col("total_pages") > 0, F.col("covered") / F.col("total_pages") * 100).otherwise(0.0))


def gap_nodes(found: DataFrame, min_pages: int = 2) -> DataFrame:
    """Placeholder sections for runs of at least min_pages pages."""
    return found.where(F.col("gap_end") - F.col("gap_start") + 1 >= min_pages).withColumn("title", F.concat(F.lit("Pages "), F.concat_ws("-", "gap_start", "gap_end")))


def overlap_share(ranges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Adds share: how much of each range (doc_id, gap_start, gap_end) leaves cover."""
    covered = leaves.select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_no")).distinct().withColumn("hit", F.lit(1.0))
    pages = ranges.select("*", F.explode(F.sequence("gap_start", "gap_end")).alias("page_no")).join(covered, ["doc_id", "page_no"], "left")
    return pages.groupBy(*ranges.columns).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
