"""The relational catalog: listings, upserts, cascades, search and comparison over sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def cascade_delete(ids: DataFrame, tables: dict[str, DataFrame], key: str = "doc_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of ids, and (table, removed) counts."""
    counts = None
    for name, t in tables.items():
        n = t.join(ids, key, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return {name: t.join(ids, key, "left_anti") for name, t in tables.items()}, counts


def latest_wins(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with each field replaced by its last non-null change; keys without a base row are added."""
    both = base.withColumn("_at", F.lit(None).cast(changes.schema[order].dataType)).unionByName(changes.withColumnRenamed(order, "_at"), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (key, "_at")]
    rank = F.struct(F.col("_at").isNotNull().alias("r"), F.col("_at"))
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in values])


def best_matches(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pair, pre, other_pre, similarity): for each section of left the most similar title of right, over a threshold.

    left and right: (pair, pre, title). Equal titles give 1, others the Jaccard
    of their words. Two titles above the threshold share one of the first words of
    either in any fixed order, if as many come first as the threshold lets
    differ, and one more. Long words, the rarer ones, come first: titles meet
    through these, never through words that all have.
    """
    words = lambda t: F.array_distinct(F.array_remove(F.split(F.lower(F.trim(t)), " "), ""))
    ordered = lambda w: F.transform(F.sort_array(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: x["x"])
    first = lambda w: F.slice(w, 1, F.size(w) - F.floor(F.size(w) * threshold).cast("int"))
    a = left.select("pair", "pre", F.lower(F.trim("title")).alias("t"), ordered(words(F.col("title"))).alias("w"))
    b = right.select("pair", F.col("pre").alias("other_pre"), F.lower(F.trim("title")).alias("ot"), ordered(words(F.col("title"))).alias("ow"))
    met = a.withColumn("word", F.explode(first(F.col("w")))).join(b.withColumn("word", F.explode(first(F.col("ow")))), ["pair", "word"])
    both = F.size(F.array_intersect("w", "ow"))
    score = F.when(F.col("t") == F.col("ot"), 1.0).otherwise(both / (F.size("w") + F.size("ow") - both))
    scored = met.select("pair", "pre", "other_pre", score.alias("similarity")).where(F.col("similarity") > threshold)
    # Titles that share several words meet several times, with one result.
    return scored.groupBy("pair", "pre").agg(F.max(F.struct("similarity", (-F.col("other_pre")).alias("o"))).alias("best")).select("pair", "pre", (-F.col("best.o")).alias("other_pre"), F.col("best.similarity").alias("similarity"))


def difference_notes(matches: DataFrame, left: DataFrame, right: DataFrame, pages: int = 5) -> DataFrame:
    """matches (pair, pre, other_pre) with notes: which summary is the longer one, or that they differ, and starts more than so many pages apart.

    left: (pair, pre, summary, start_page), right: (pair, other_pre, summary, start_page). A null summary is an empty one.
    """
    a = left.select("pair", "pre", F.coalesce("summary", F.lit("")).alias("s1"), F.col("start_page").alias("p1"))
    b = right.select("pair", "other_pre", F.coalesce("summary", F.lit("")).alias("s2"), F.col("start_page").alias("p2"))
    # The notes.
    summary = F.when(F.length("s1") > F.length("s2"), "文档1的摘要更详细").when(F.length("s2") > F.length("s1"), "文档2的摘要更详细").when(F.col("s1") != F.col("s2"), "摘要内容不同")
    start = F.when(F.abs(F.col("p1") - F.col("p2")) > pages, F.format_string("起始页码差异较大: %d vs %d", "p1", "p2"))
    return matches.join(a, ["pair", "pre"]).join(b, ["pair", "other_pre"]).withColumn("notes", F.array_compact(F.array(summary, start))).drop("s1", "s2", "p1", "p2")


def newest(df: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first n rows of every key; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
