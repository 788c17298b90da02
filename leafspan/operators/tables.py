"""Tables in texts, and contents pages by patterns that are data."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from leafspan.functions import text as T


def table_regions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, first_line, last_line, columns, rows, markdown): runs of lines with a bar, counted from 0, as Markdown tables.

    Only lines of tables leave their row. A run of nothing but a rule of dashes is none.
    """
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: F.contains(x["line"], F.lit("|")))
    own = docs.select(id_col, F.inline(lines)).withColumn("run", F.col("at") - F.row_number().over(W.partitionBy(id_col).orderBy("at")))
    grouped = own.groupBy(id_col, "run").agg(
        F.min("at").alias("first_line"), F.max("at").alias("last_line"),
        F.transform(F.sort_array(F.collect_list(F.struct("at", T.table_cells(F.col("line")).alias("cells")))), lambda x: x["cells"]).alias("all"),
    )
    found = grouped.withColumn("cells", F.filter("all", lambda r: F.size(r) > 0)).where(F.size("cells") > 0)
    return found.select(id_col, "first_line", "last_line", F.array_max(F.transform("cells", lambda r: F.size(r))).alias("columns"), F.size("cells").alias("rows"), T.markdown_table(F.col("cells")).alias("markdown"))


def with_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the tables of their texts as Markdown between [TABLE] and [/TABLE]; ids are unique. All other lines stay as they are."""
    regions = table_regions(docs, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line", "markdown"))).alias("_tables"))
    lines = F.split(text_col, "\n")
    before = lambda i: F.when(i > 0, F.col("_tables")[F.greatest(i - 1, F.lit(0))]["last_line"] + 1).otherwise(0)
    shown = lambda t, i: F.concat(F.slice("_lines", before(i) + 1, t["first_line"] - before(i)), F.array(F.concat(F.lit("[TABLE]\n"), t["markdown"], F.lit("\n[/TABLE]"))))
    rest = F.slice("_lines", F.element_at("_tables", -1)["last_line"] + 2, F.size("_lines"))
    text = F.when(F.col("_tables").isNull(), F.col(text_col)).otherwise(F.array_join(F.concat(F.flatten(F.transform("_tables", shown)), rest), "\n"))
    return docs.join(regions, id_col, "left").withColumn("_lines", lines).withColumn(text_col, text).drop("_tables", "_lines")


@F.pandas_udf(StringType())
def usable(patterns: pd.Series) -> pd.Series:
    """Regular expressions as Java has them; null for what is none."""

    def one(p: str | None) -> str | None:
        try:
            re.compile(p)
        except (re.error, TypeError):
            return None
        return p.replace("(?P<", "(?<") if "(?P=" not in p and "(?(" not in p else None

    return patterns.map(one)


def nested_contents(pages: DataFrame, patterns: DataFrame, after_page: int = 20, least_lines: int = 3, most: int = 5) -> DataFrame:
    """(doc_id, page_no, matched_patterns, match_count, confidence): the first pages of each document behind after_page that look like its contents.

    patterns: (doc_id, position, name, regex), what was learned of each document's
    own contents; broken ones are left out. A pattern counts on a page where
    least_lines of its lines have it; match_count is the lines of all that
    count. Ten give high confidence, five medium, fewer low. Patterns meet
    pages as one array a document, so a page is split into lines once.
    """
    known = patterns.withColumn("regex", usable("regex")).where("regex is not null")
    learned = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "name", "regex"))).alias("patterns"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: T.stripped(x)), lambda x: x != "")
    counted = lambda p: F.struct(p["name"].alias("name"), F.size(F.filter("lines", lambda x: F.rlike(x, p["regex"]))).alias("n"))
    met = pages.where(F.col("page_no") > after_page).join(learned, "doc_id").select("doc_id", "page_no", "patterns", lines.alias("lines"))
    met = met.select("doc_id", "page_no", F.filter(F.transform("patterns", counted), lambda p: p["n"] >= least_lines).alias("hits")).where(F.size("hits") > 0)
    total = F.aggregate("hits", F.lit(0), lambda a, p: a + p["n"])
    found = met.select("doc_id", "page_no", F.transform("hits", lambda p: p["name"]).alias("matched_patterns"), total.alias("match_count"))
    found = found.withColumn("confidence", F.when(F.col("match_count") >= 10, "high").when(F.col("match_count") >= 5, "medium").otherwise("low"))
    return found.withColumn("_rn", F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))).where(F.col("_rn") <= most).drop("_rn")


def first_run(pages: DataFrame, flag, first_n: int = 20, beyond: bool = True) -> DataFrame:
    """(doc_id, first_page, last_page): the first run of flagged pages that begins among the first first_n; beyond says whether it may go on past them.

    A run is pages with one difference of page and rank, and no flagged page of a later run is looked at twice.
    """
    own = pages.where(flag) if beyond else pages.where(flag & (F.col("page_no") <= first_n))
    runs = own.select("doc_id", "page_no", (F.col("page_no") - F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))).alias("run"))
    ends = runs.groupBy("doc_id", "run").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).where(F.col("first_page") <= first_n)
    return ends.groupBy("doc_id").agg(F.min("first_page").alias("first_page"), F.min_by("last_page", "first_page").alias("last_page"))
