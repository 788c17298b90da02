"""Section trees: from lists to trees and along them. Everything is keyed by doc_id; pre is the place in preorder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leafspan.functions import text as T


def by_doc():
    return W.partitionBy("doc_id").orderBy("pre")


def siblings():
    return W.partitionBy("doc_id", "parent_pos").orderBy("pre")


def deepest(df: DataFrame, column: str = "depth") -> int:
    """The greatest depth in df: one job, one number. Trees of any depth are asked for theirs."""
    return int(df.agg(F.max(column)).first()[0] or 1)


def structure_codes(items: DataFrame, max_level: int | None = None, key: str = "doc_id", order: str = "list_index", level: str = "level") -> DataFrame:
    """Adds the dotted code of every item of a list of levels: counters that shallower levels restart.

    Absent levels aren't in the code. A counter is what has been seen of its
    level, less what had been at the last shallower item: one sort a document for all.
    """
    levels = range(1, (max_level or deepest(items, level)) + 1)
    so_far = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = items.withColumn("_seen", F.array(*[F.sum((F.col(level) == n).cast("int")).over(so_far) for n in levels]))
    df = df.withColumn("_before", F.array(*[F.last(F.when(F.col(level) < n, F.col("_seen")[n - 1]), ignorenulls=True).over(so_far) for n in levels]))
    count = [F.col("_seen")[n - 1] - F.coalesce(F.col("_before")[n - 1], F.lit(0)) for n in levels]
    parts = [F.when((F.col(level) >= n) & (c > 0), c.cast("string")) for n, c in zip(levels, count, strict=True)]
    return df.withColumn("structure", F.concat_ws(".", *parts)).drop("_seen", "_before")


def _above(max_depth: int, *columns: str) -> Column:
    """For each depth but the last, the last earlier row that is no deeper, as a struct of columns; those of smaller depth than the row's are its ancestors."""
    before = by_doc().rowsBetween(W.unboundedPreceding, -1)
    found = [F.last(F.when(F.col("depth") <= d, F.struct(*columns)), ignorenulls=True).over(before) for d in range(1, max_depth)]
    return F.array(*found) if found else F.array().cast("array<struct<" + ",".join(f"{c}:int" for c in columns) + ">>")


def _after(max_depth: int, *columns: str) -> Column:
    """The first later row that isn't below this one, as a struct of columns; null for none. Runs backwards, so that no frame is read twice."""
    later = W.partitionBy("doc_id").orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, -1)
    return F.get(F.array(*[F.last(F.when(F.col("depth") <= d, F.struct(*columns)), ignorenulls=True).over(later) for d in range(1, max_depth + 1)]), F.col("depth") - 1)


def parents(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Adds parent_pos: the nearest row before with a smaller depth."""
    df = nodes.withColumn("_above", _above(max_depth or deepest(nodes), "pre"))
    return df.withColumn("parent_pos", F.when(F.col("depth") > 1, F.get("_above", F.col("depth") - 2)["pre"])).drop("_above")


def end_pages(nodes: DataFrame, totals: DataFrame | None = None, max_leaf: int = 2, max_depth: int | None = None) -> DataFrame:
    """Adds end_page. nodes: (doc_id, pre, parent_pos, depth, start_page) and total_pages, or totals: (doc_id, total_pages).

    A leaf ends where its next sibling starts; a last leaf at its boundary, where
    what follows its parent starts, or after max_leaf pages, a last root leaf with
    the document. An inner node ends with its last child: the nodes that end at
    one row are a chain, along which a running maximum goes up.
    """
    df = nodes.join(totals, "doc_id") if totals is not None else nodes
    backwards = W.partitionBy("doc_id").orderBy(F.desc("pre"))
    df = df.withColumn("_next", _after(max_depth or deepest(nodes), "pre", "parent_pos", "start_page")).withColumn("_inner", F.coalesce(F.lag("depth").over(backwards) > F.col("depth"), F.lit(False)))
    sibling = F.when(F.col("_next").isNotNull() & F.col("_next.parent_pos").eqNullSafe(F.col("parent_pos")), F.col("_next.start_page"))
    last = F.when(F.col("depth") == 1, F.col("total_pages")).otherwise(F.least(F.coalesce(F.col("_next.start_page") - 1, F.col("total_pages")), F.col("start_page") + max_leaf - 1))
    df = df.withColumn("_end", F.when(F.col("_inner"), F.col("start_page")).otherwise(F.greatest(F.coalesce(sibling, last), "start_page"))).withColumn("_until", F.coalesce("_next.pre", F.lit(-1)))
    chain = W.partitionBy("doc_id", "_until").orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("end_page", F.max("_end").over(chain)).drop("_next", "_inner", "_end", "_until", "total_pages")


def promote_chapters(outline: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, page) with invalid titles dropped, chapters on level 1, repeated chapters
    dropped with what is below them, and appendices after a chapter on level 2."""
    order = W.partitionBy("doc_id").orderBy("pos")
    df = outline.where(T.is_valid_title(F.col("title"))).withColumn("chapter", T.is_chapter(F.col("title")))
    df = df.withColumn("again", F.col("chapter") & (F.row_number().over(W.partitionBy("doc_id", "title").orderBy("pos")) > 1))
    # A repeated chapter opens a group; its rows go until one is not deeper.
    df = df.withColumn("grp", F.sum(F.col("again").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    group = W.partitionBy("doc_id", "grp").orderBy("pos")
    df = df.withColumn("head", F.first("level").over(group)).withColumn("rn", F.row_number().over(group))
    after = F.min(F.when(F.col("rn") > 1, F.col("level"))).over(group.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("skip", (F.col("grp") > 0) & ((F.col("rn") == 1) | (after > F.col("head")))).where("NOT skip")
    seen = F.coalesce(F.max("chapter").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    level = F.when(F.col("chapter"), 1).when((F.col("level") == 1) & T.is_appendix(F.col("title")) & seen, 2).otherwise(F.col("level"))
    return df.select("doc_id", "pos", level.alias("level"), "title", "page")


def exact_parents(items: DataFrame) -> DataFrame:
    """Adds parent_pos: the latest earlier item whose code is this one's without its last part; null for roots and orphans.

    Each item asks at its parent's code and answers at its own: of both, by
    document and code, the last answer before a question is its parent. One
    exchange, no pairs, however often codes repeat.
    """
    columns = items.columns
    parent = F.when(F.instr("structure", ".") > 0, F.regexp_replace("structure", r"\.[^.]*$", ""))
    row = F.struct(*columns)
    asked = items.select("doc_id", parent.alias("_code"), F.col("list_index").alias("_at"), F.lit(0).alias("_answer"), row.alias("_row"))
    answers = items.where("structure is not null").select("doc_id", F.col("structure").alias("_code"), F.col("list_index").alias("_at"), F.lit(1).alias("_answer"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    # An item's question comes before its own answer.
    order = W.partitionBy("doc_id", "_code").orderBy("_at", "_answer").rowsBetween(W.unboundedPreceding, -1)
    found = F.when(F.col("_code").isNotNull(), F.last(F.when(F.col("_answer") == 1, F.col("_at")), ignorenulls=True).over(order))
    return asked.unionByName(answers).withColumn("parent_pos", found).where("_answer = 0").select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], "parent_pos")


def hierarchical_ids(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Adds id: 1, 1.1, 1.1.1 by the order of siblings."""
    ranked = nodes.withColumn("_rank", F.row_number().over(siblings()).cast("string"))
    return paths(ranked, max_depth, "_rank", "_ranks").withColumn("id", F.array_join("_ranks", ".")).drop("_rank", "_ranks")


def sequential_ids(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("id", F.lpad((F.row_number().over(by_doc()) - 1).cast("string"), 4, "0"))


def flatten(nodes: DataFrame, max_depth: int = 3, max_nodes: int = 100) -> DataFrame:
    """The first max_nodes nodes to max_depth in preorder, with has_children."""
    kids = nodes.where("parent_pos is not null").select("doc_id", F.col("parent_pos").alias("pre")).distinct().withColumn("has_children", F.lit(True))
    top = nodes.where(F.col("depth") <= max_depth).withColumn("rn", F.row_number().over(by_doc())).where(F.col("rn") <= max_nodes).drop("rn")
    return top.join(kids, ["doc_id", "pre"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def paths(nodes: DataFrame, max_depth: int | None = None, column: str = "node_id", out: str = "path") -> DataFrame:
    """Adds the column's values from the root to the node."""
    max_depth = max_depth or deepest(nodes)
    df = nodes.withColumn("_above", _above(max_depth, "depth", column))
    up = [F.when((F.col("depth") > d) & (F.col("_above")[d - 1]["depth"] == d), F.col("_above")[d - 1]) for d in range(1, max_depth)]
    above = F.transform(F.filter(F.array(*up), lambda x: x.isNotNull()), lambda x: x[column]) if up else F.array().cast(f"array<{nodes.schema[column].dataType.simpleString()}>")
    return df.withColumn(out, F.concat(above, F.array(column))).drop("_above")


def subtree_ends(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Adds last_pre: where the node's subtree ends in preorder. One range of pre is a subtree."""
    later = _after(max_depth or deepest(nodes), "pre")["pre"]
    return nodes.withColumn("_later", later).withColumn("last_pre", F.coalesce(F.col("_later") - 1, F.max("pre").over(W.partitionBy("doc_id")))).drop("_later")


def rollup(nodes: DataFrame, value: str = "tokens", max_depth: int | None = None) -> DataFrame:
    """Adds last_pre and subtree, the sum of a value (0 or more) over the node and all below it: a difference of running sums, no join."""
    df = subtree_ends(nodes, max_depth).withColumn("_run", F.sum(value).over(by_doc().rowsBetween(W.unboundedPreceding, 0)))
    # Of the rows that end at one place the last is that place itself.
    return df.withColumn("subtree", F.max("_run").over(W.partitionBy("doc_id", "last_pre")) - F.col("_run") + F.col(value)).drop("_run")


def is_leaf() -> Column:
    """Whether the next node in preorder isn't deeper; needs nothing but the window that other columns use."""
    return F.coalesce(F.lead("depth").over(by_doc()) <= F.col("depth"), F.lit(True))


_HEADING = r"^(#{1,6})\s+(.+)$"


def _with_headings(lines: DataFrame) -> DataFrame:
    """Adds head: whether a line is a Markdown heading outside of code fences."""
    order = W.partitionBy("doc_id").orderBy("line_num").rowsBetween(W.unboundedPreceding, 0)
    fence = F.ltrim("line").startswith("```")
    df = lines.withColumn("_inside", F.sum(fence.cast("int")).over(order) % 2 == 1)
    return df.withColumn("head", ~fence & ~F.col("_inside") & F.col("line").rlike(_HEADING)).drop("_inside")


def headings(lines: DataFrame) -> DataFrame:
    """Markdown headings outside of code fences: (doc_id, line_num, level, title) of lines (doc_id, line_num, line)."""
    return _with_headings(lines).where("head").select("doc_id", "line_num", F.length(F.regexp_extract("line", _HEADING, 1)).alias("level"), F.trim(F.regexp_extract("line", _HEADING, 2)).alias("title"))


def section_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_num, text): each heading with the lines up to the next one, trimmed.

    Headings and what they head come from two windows of one order, so lines are read and sorted once.
    """
    order = W.partitionBy("doc_id").orderBy("line_num").rowsBetween(W.unboundedPreceding, 0)
    owned = _with_headings(lines).withColumn("owner", F.max(F.when(F.col("head"), F.col("line_num"))).over(order)).where("owner is not null")
    return owned.groupBy("doc_id", F.col("owner").alias("line_num")).agg(
        F.btrim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_num", "line"))), lambda x: x["line"]), "\n"), F.lit(" \n\t\r")).alias("text")
    )


def node_text(nodes: DataFrame, pages: DataFrame, max_chars: int = 5000) -> DataFrame:
    """(doc_id, pre, text, tokens): pages of the node's range joined by blank lines and cut. Ranges become equi-joins."""
    wanted = nodes.select("doc_id", "pre", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    got = wanted.join(pages, ["doc_id", "page_no"]).groupBy("doc_id", "pre").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.sum("tokens").cast("int").alias("tokens")
    )
    return got.withColumn("text", F.when(F.length("text") > max_chars, F.concat(F.left("text", F.lit(max_chars)), F.lit("..."))).otherwise(F.col("text")))


def merge_deep(nodes: DataFrame, limit: int, max_depth: int | None = None) -> DataFrame:
    """Nodes to a depth of limit, with sub_items: for those at the limit the titles of all below them, in preorder; else an empty array.

    A node below the limit is grouped by its ancestor there, which its path names.
    """
    placed = paths(nodes, max_depth, "pre", "_path")
    below = placed.where(F.col("depth") > limit).groupBy("doc_id", F.get("_path", F.lit(limit - 1)).alias("pre"))
    titles = below.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("pre").alias("at"), "title"))), lambda x: x["title"]).alias("sub_items"))
    return nodes.where(F.col("depth") <= limit).join(titles, ["doc_id", "pre"], "left").withColumn("sub_items", F.coalesce("sub_items", F.array().cast("array<string>")))


def promote_equal_children(nodes: DataFrame, totals: DataFrame, max_leaf: int = 2, max_depth: int | None = None) -> DataFrame:
    """(doc_id, pre, node_id, parent_pos, depth, title, start_page, end_page) with no first child that repeats its parent's title.

    Titles compare without white space and case; empty ones repeat nothing. Such
    a child goes, its children take its place in its parent, before their
    uncles, and all below move up a level; a chain of them goes as a whole. Codes,
    parents and end pages are made anew. In preorder a first child follows its
    parent, so one look back finds it, and order never changes.
    """
    max_depth = max_depth or deepest(nodes)
    key = T.title_key(F.col("title"))
    same = (F.col("depth") > F.lag("depth").over(by_doc())) & (F.lag(key).over(by_doc()) == key) & (key != "")
    marked = nodes.withColumn("_cut", F.coalesce(same, F.lit(False)).cast("int"))
    # Cuts on the way from the root are levels to move up.
    moved = paths(marked, max_depth, "_cut", "_cuts").where("_cut = 0")
    level = (F.col("depth") - F.aggregate("_cuts", F.lit(0), lambda a, x: a + x)).cast("int")
    kept = moved.select("doc_id", "pre", level.alias("depth"), "title", "start_page")
    coded = structure_codes(kept, max_depth, order="pre", level="depth").withColumnRenamed("structure", "node_id")
    ended = end_pages(parents(coded, max_depth), totals, max_leaf, max_depth)
    return ended.select("doc_id", "pre", "node_id", "parent_pos", "depth", "title", "start_page", "end_page")
