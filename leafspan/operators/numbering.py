"""Numbers in titles: systems, holes and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafspan.functions import text as T


def numbering_holes(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_pos, system, lo, hi, missing, repeated): for the titles of siblings in one system of numbering the numbers that are left out between the least and the greatest, and those that more than one has.

    Titles without a number, and numbers beyond a million, are in none.
    """
    number = T.title_number(F.col("title"))
    own = nodes.select("doc_id", "parent_pos", T.numbering_system(F.col("title")).alias("system"), number.alias("v")).where("v is not null AND v < 1000000")
    # Counted by number first, so that a group is as long as its numbers, not as its titles.
    each = own.groupBy("doc_id", "parent_pos", "system", "v").agg(F.count("*").alias("n"))
    found = each.groupBy("doc_id", "parent_pos", "system").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.collect_list("v").alias("seen"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("v")))).alias("repeated"))
    return found.select("doc_id", "parent_pos", "system", "lo", "hi", F.sort_array(F.array_except(F.sequence("lo", "hi"), "seen")).alias("missing"), "repeated")
