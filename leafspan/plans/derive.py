"""Inputs derived from the given tables, the same in Spark and in SQL.

The corpus has no section structure, so one is laid over it by rule: two lines
make a page, every page heads a section, levels follow from document and
position. Each function has its twin among the common table expressions of
``SQL``, by name.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafspan.functions import text as T
from leafspan.operators import hierarchy as H

PAGE_LINES = 2
LEVELS = 5  # of the derived trees
MAX_LEAF = 2  # pages of a last leaf, so that gaps are left


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-stream-")


def paged(docs: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """(doc_id, page_no, text, total_pages): so many lines make a page. No shuffle: pages come from the row's own array."""
    split = docs.where("text is not null").select("doc_id", F.split("text", "\n").alias("l")).withColumn("total_pages", F.expr(f"cast(ceil(size(l) / {lines}) as int)"))
    pages = F.expr(f"transform(sequence(1, total_pages), p -> array_join(slice(l, (p - 1) * {lines} + 1, {lines}), '\\n'))")
    return split.select("doc_id", "total_pages", F.posexplode(pages).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_no"), "text", "total_pages")


def pages_of(docs: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """(doc_id, page_no, text, tokens) of paged()."""
    return paged(docs, lines).select("doc_id", "page_no", "text", T.estimate_tokens(F.col("text")).alias("tokens"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(table(spark, sf_dir, "documents"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = paged(table(spark, sf_dir, "documents")).where("NOT (doc_id % 5 = 0 AND page_no <= 3)")
    title = F.substring(F.trim(F.element_at(F.split("text", "\n"), 1)), 1, 60)
    items = pages.select(
        "doc_id",
        (F.col("page_no") - 1).alias("list_index"),
        F.expr(f"cast(if(page_no = 1, 1, 1 + ((page_no - 1) * (1 + doc_id % 4) + doc_id) % {LEVELS}) as int)").alias("level"),
        F.when((F.col("doc_id") + F.col("page_no") - 1) % 11 == 0, F.concat(title, F.lit(" zzq"))).otherwise(title).alias("title"),
        F.expr("cast(page_no - doc_id % 4 as int)").alias("page"),
        F.col("page_no").alias("physical_index"),
        "total_pages",
    )
    return H.structure_codes(items, LEVELS)


def toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, list_index, level, structure, title, page, physical_index): one item a page, on up to five levels; every eleventh title is off."""
    return _items(spark, sf_dir).select("doc_id", "list_index", "level", "structure", "title", "page", "physical_index")


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.expr(f"cast(ceil(size(split(text, '\\n')) / {PAGE_LINES}) as int)").alias("total_pages"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pre, node_id, parent_pos, depth, title, start_page, end_page): the section trees. One scan, one exchange."""
    items = _items(spark, sf_dir).select(
        "doc_id", F.col("list_index").alias("pre"), F.col("structure").alias("node_id"), T.code_level(F.col("structure")).alias("depth"), "title", F.col("physical_index").alias("start_page"), "total_pages"
    )
    ended = H.end_pages(H.parents(items, LEVELS), max_leaf=MAX_LEAF, max_depth=LEVELS)
    return ended.select("doc_id", "pre", "node_id", "parent_pos", "depth", "title", "start_page", "end_page")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suggestion_id, doc_id, node_id, pre, action, confidence, status, suggested_title): edits proposed for every third node."""
    n = F.col("doc_id") * 31 + F.col("pre")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    own = nodes(spark, sf_dir).where((F.col("doc_id") + F.col("pre")) % 3 == 0)
    return own.select(
        F.concat_ws("-", "doc_id", "pre").alias("suggestion_id"), "doc_id", "node_id", "pre", "title", "start_page", "end_page",
        pick(["DELETE", "MODIFY_FORMAT", "MODIFY_PAGE", "ADD"], n).alias("action"),
        pick(["high", "medium", "low"], F.floor(n / 4)).alias("confidence"),
        pick(["pending", "accepted", "rejected"], F.floor(n / 12)).alias("status"),
        F.concat(F.lit("New "), T.strip_numbering(F.col("title"))).alias("suggested_title"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("document_id"), F.to_date("o_orderdate").alias("start_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_add(F.to_date("o_orderdate"), 60)).alias("end_date"), F.col("o_totalprice").alias("budget"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN '元' WHEN 1 THEN '万元' ELSE '亿元' END").alias("budget_unit"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("operation"),
        F.get_json_object("props", "$.k").try_cast("int").alias("tokens"), F.col("value").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"),
    )


_TOKENS = "(length(regexp_replace({0}, '[^一-鿿]', '', 'g')) // 2 + length(regexp_replace({0}, '[一-鿿]', '', 'g')) // 4)"

#: Common table expressions in DuckDB SQL, each with those it reads.
SQL = {
    "doc_pages": (
        (),
        f"""SELECT doc_id, p AS page_no, text, CAST({_TOKENS.format("text")} AS INT) AS tokens FROM (
        SELECT doc_id, p, array_to_string(l[(p - 1) * 2 + 1 : p * 2], chr(10)) AS text FROM (
        SELECT doc_id, l, CAST(unnest(generate_series(1, (len(l) + 1) // 2)) AS INT) AS p FROM (
        SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))""",
    ),
    "toc_raw": (
        ("doc_pages",),
        f"""SELECT doc_id, page_no - 1 AS list_index, CAST(CASE WHEN page_no = 1 THEN 1 ELSE 1 + ((page_no - 1) * (1 + doc_id % 4) + doc_id) % {LEVELS} END AS INT) AS level,
        substr(trim(string_split(text, chr(10))[1]), 1, 60) || CASE WHEN (doc_id + page_no - 1) % 11 = 0 THEN ' zzq' ELSE '' END AS title,
        CAST(page_no - doc_id % 4 AS INT) AS page, page_no AS physical_index FROM doc_pages WHERE NOT (doc_id % 5 = 0 AND page_no <= 3)""",
    ),
    "toc_groups": (
        ("toc_raw",),
        "SELECT *, " + ", ".join(f"sum(CAST(level < {n} AS INT)) OVER (PARTITION BY doc_id ORDER BY list_index) AS g{n}" for n in range(1, LEVELS + 1)) + " FROM toc_raw",
    ),
    "toc_items": (
        ("toc_groups",),
        "SELECT doc_id, list_index, level, concat_ws('.', "
        + ", ".join(f"CASE WHEN level >= {n} AND n{n} > 0 THEN CAST(n{n} AS VARCHAR) END" for n in range(1, LEVELS + 1))
        + ") AS structure, title, page, physical_index FROM (SELECT *, "
        + ", ".join(f"sum(CAST(level = {n} AS INT)) OVER (PARTITION BY doc_id, g{n} ORDER BY list_index) AS n{n}" for n in range(1, LEVELS + 1))
        + " FROM toc_groups)",
    ),
    "totals": ((), "SELECT doc_id, CAST((len(string_split(text, chr(10))) + 1) // 2 AS INT) AS total_pages FROM documents WHERE text IS NOT NULL"),
    "flat": (
        ("toc_items",),
        "SELECT doc_id, list_index AS pre, structure AS node_id, CAST(len(string_split(structure, '.')) AS INT) AS depth, title, physical_index AS start_page FROM toc_items",
    ),
    "tree": (
        ("flat",),
        """SELECT a.*, up.parent_pos FROM flat a LEFT JOIN (SELECT t.doc_id, t.pre, max(u.pre) AS parent_pos FROM flat t JOIN flat u ON u.doc_id = t.doc_id AND u.pre < t.pre AND u.depth < t.depth GROUP BY ALL) up USING (doc_id, pre)""",
    ),
    "bounded": (
        ("tree", "totals"),
        """SELECT a.*, total_pages, lead(start_page) OVER (PARTITION BY a.doc_id, parent_pos ORDER BY pre) AS next_start,
        EXISTS (SELECT 1 FROM tree k WHERE k.doc_id = a.doc_id AND k.parent_pos = a.pre) AS inner_node FROM tree a JOIN totals USING (doc_id)""",
    ),
    "bounds": (
        ("bounded",),
        """SELECT doc_id, pre, coalesce(next_start - 1, total_pages) AS boundary FROM bounded WHERE parent_pos IS NULL
        UNION ALL SELECT a.doc_id, a.pre, coalesce(a.next_start - 1, b.boundary) FROM bounded a JOIN bounds b ON a.doc_id = b.doc_id AND a.parent_pos = b.pre""",
    ),
    "ends": (
        ("bounded", "bounds"),
        f"""SELECT a.doc_id, a.pre, greatest(start_page, coalesce(next_start, CASE WHEN depth = 1 THEN total_pages ELSE least(b.boundary, start_page + {MAX_LEAF} - 1) END)) AS end_page
        FROM bounded a LEFT JOIN bounds b ON a.doc_id = b.doc_id AND a.parent_pos = b.pre WHERE NOT inner_node
        UNION ALL SELECT p.doc_id, p.pre, greatest(k.end_page, p.start_page) FROM ends k JOIN (SELECT doc_id, parent_pos, max(pre) AS last_kid FROM bounded WHERE parent_pos IS NOT NULL GROUP BY ALL) l
        ON l.doc_id = k.doc_id AND l.last_kid = k.pre JOIN bounded p ON p.doc_id = l.doc_id AND p.pre = l.parent_pos""",
    ),
    "nodes": (
        ("tree", "ends"),
        "SELECT t.doc_id, t.pre, node_id, parent_pos, depth, title, start_page, CAST(end_page AS INT) AS end_page FROM tree t JOIN ends USING (doc_id, pre)",
    ),
    "suggestions": (
        ("nodes",),
        """SELECT concat_ws('-', doc_id, pre) AS suggestion_id, doc_id, node_id, pre, title, start_page, end_page,
        (['DELETE', 'MODIFY_FORMAT', 'MODIFY_PAGE', 'ADD'])[CAST((doc_id * 31 + pre) % 4 + 1 AS INT)] AS action,
        (['high', 'medium', 'low'])[CAST((doc_id * 31 + pre) // 4 % 3 + 1 AS INT)] AS confidence,
        (['pending', 'accepted', 'rejected'])[CAST((doc_id * 31 + pre) // 12 % 3 + 1 AS INT)] AS status,
        'New ' || {strip(title)} AS suggested_title FROM nodes WHERE (doc_id + pre) % 3 = 0""",
    ),
    "timeline": (
        (),
        """SELECT o_orderkey AS entry_id, o_custkey AS document_id, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 60 END AS end_date,
        o_totalprice AS budget, CASE o_orderkey % 3 WHEN 0 THEN '元' WHEN 1 THEN '万元' ELSE '亿元' END AS budget_unit FROM orders""",
    ),
    "call_log": (
        (),
        """SELECT event_id AS log_id, user_id AS document_id, event_type AS operation, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS tokens, value AS duration_ms,
        event_type <> 'error' AS success, ts AS created_at FROM events""",
    ),
}


def strip_sql(title: str) -> str:
    """strip_numbering() in DuckDB SQL."""
    title = f"regexp_replace(coalesce({title}, ''), '^\\s+|\\s+$', '', 'g')"
    for pattern in T.NUMBERING:
        title = f"regexp_replace({title}, '{pattern}', '')"
    return f"trim({title}, '、，,．.·: ' || chr(9))"


def sql(query: str, *needs: str) -> str:
    """A query over derived tables, with the common table expressions it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in SQL[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    body = ",\n".join(f"{n} AS {'' if ' UNION ALL SELECT' in SQL[n][1] else 'MATERIALIZED '}({SQL[n][1].replace('{strip(title)}', strip_sql('title'))})" for n in order)
    return f"WITH RECURSIVE {body}\n{query}".rstrip() if body else query
