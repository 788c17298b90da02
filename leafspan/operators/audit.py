"""Proposed edits to section trees: evidence, plan, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafspan.functions import text as T


def delete_evidence(title: Column, page: Column, confidence: Column) -> Column:
    at = F.instr(page, title)
    score = (
        F.lit(0.3) + F.when(confidence == "high", 0.5).otherwise(0.0) + F.when(F.length(title) > 80, 0.2).otherwise(0.0)
        + F.when(F.regexp_count(title, F.lit(r"[.。]")) >= 2, 0.2).otherwise(0.0) + F.when(at > 100, 0.1).otherwise(0.0)
        + F.when(title.rlike("^[0-9]+") & (F.length(title) > 50), 0.1).otherwise(0.0)
    )
    return F.least(score, F.lit(0.95))


def format_evidence(title: Column, wanted: Column) -> Column:
    same = (T.strip_numbering(title) == T.strip_numbering(wanted)) | (F.rtrim(title) == F.rtrim(wanted))
    return F.when(same, 0.7).otherwise(0.4)


def page_evidence(start: Column, end: Column, new_start: Column, new_end: Column, title: Column, page: Column) -> Column:
    span, new = end - start + 1, new_end - new_start + 1
    fits = ((span > 15) & (new < span)) | ((span < 3) & (new > span))
    return F.when(fits & F.contains(page, F.left(title, F.lit(20))), 0.6).otherwise(0.3)


def add_evidence(title: Column, start: Column, end: Column, page: Column) -> Column:
    return F.when(start > end, 0.0).when(F.contains(page, F.left(title, F.lit(15))), 0.8).otherwise(0.2)


def plan(advice: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds step and outcome: the order in which edits run, and whether they do."""
    rank = F.create_map(*[F.lit(x) for kv in (("DELETE", 1), ("MODIFY_PAGE", 2), ("MODIFY_FORMAT", 3), ("ADD", 4)) for x in kv])
    score = F.create_map(*[F.lit(x) for kv in (("high", 0.9), ("medium", 0.7), ("low", 0.5)) for x in kv])
    df = advice.withColumn("score", score[F.col("confidence")])
    df = df.withColumn("step", F.row_number().over(W.partitionBy("doc_id").orderBy(F.coalesce(rank[F.col("action")], F.lit(9)), F.desc("score"), "pre")))
    return df.withColumn("outcome", F.when(F.col("action") == "ADD", "skipped").when(F.col("score") >= threshold, "run").otherwise("below_threshold"))


def apply_deletes(nodes: DataFrame, deletes: DataFrame) -> DataFrame:
    """nodes without the subtrees of deletes (doc_id, pre, last_pre); roots that are a document's only node stay.

    Running maximum of the deleted ranges' ends: no range join.
    """
    df = nodes.join(deletes.select("doc_id", "pre", F.col("last_pre").alias("_gone")), ["doc_id", "pre"], "left")
    order = W.partitionBy("doc_id").orderBy("pre").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_until", F.max("_gone").over(order)).where("_until is null OR pre > _until").drop("_gone", "_until")


def latest_per_node(edits: DataFrame, order: str) -> DataFrame:
    return edits.withColumn("_rn", F.row_number().over(W.partitionBy("doc_id", "pre").orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def snapshot(versions: DataFrame, now: DataFrame) -> DataFrame:
    """versions (doc_id, version and the tree's columns) with the trees of now as the next version of their documents."""
    last = versions.groupBy("doc_id").agg(F.max("version").alias("_last"))
    new = now.join(last, "doc_id", "left").withColumn("version", F.coalesce(F.col("_last") + 1, F.lit(1))).drop("_last")
    return versions.unionByName(new.select(*versions.columns))


def restore(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """versions with those of wanted (doc_id, version) copied as the newest of their documents; what was current stays as a snapshot."""
    return snapshot(versions, versions.join(wanted, ["doc_id", "version"], "left_semi").drop("version"))


def conflicts(edits: DataFrame) -> DataFrame:
    """(doc_id, node_id, actions): pending nodes to be both deleted and changed."""
    own = edits.where("status = 'pending'").groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_set("action")).alias("actions"))
    return own.where(F.array_contains("actions", "DELETE") & F.exists("actions", lambda a: a.startswith("MODIFY")))


def quality(done: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, score, original_nodes, optimized_nodes, removal_rate): points by kind of edit that was done, up to a limit each, and the share of nodes that is gone."""
    n = lambda a: F.sum((F.col("action") == a).cast("int"))
    changes = done.groupBy("doc_id").agg(n("DELETE").alias("_d"), n("MODIFY_FORMAT").alias("_f"), n("MODIFY_PAGE").alias("_p"))
    sizes = before.groupBy("doc_id").agg(F.count("*").alias("original_nodes")).join(after.groupBy("doc_id").agg(F.count("*").alias("_left")), "doc_id", "left")
    points = lambda c, each, most: F.least(F.lit(most), each * F.coalesce(F.col(c), F.lit(0)))
    left = F.coalesce(F.col("_left"), F.lit(0))
    return sizes.join(changes, "doc_id", "left").select(
        "doc_id", F.least(F.lit(100), 60 + points("_d", 4, 20) + points("_f", 3, 10) + points("_p", 5, 10)).alias("score"), "original_nodes", left.alias("optimized_nodes"), ((F.col("original_nodes") - left) / F.col("original_nodes")).alias("removal_rate")
    )
