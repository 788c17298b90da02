"""Titles to pages: checks, offsets, neighbours and repairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from leafspan.functions import text as T


def validate_mapping(items: DataFrame, pages: DataFrame, totals: DataFrame, offset=0) -> DataFrame:
    """Adds physical and passed: page + offset, and whether the title is on it."""
    df = items.join(totals, "doc_id").withColumn("physical", F.when(F.col("page") >= 1, F.col("page") + offset))
    text = pages.select("doc_id", F.col("page_no").alias("physical"), F.col("text").alias("page_text"))
    df = df.join(text, ["doc_id", "physical"], "left")
    return df.withColumn("passed", F.coalesce(T.title_in_page(F.col("title"), F.col("page_text")), F.lit(False))).drop("page_text")


PAGES_AT_ONCE = 1000  # of a document, in one search


def title_hits(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, list_index, page_no, ends): the pages from lo to hi that have an item's title, and where in them it first ends.

    items: (doc_id, list_index, title, lo, hi); pages: (doc_id, page_no, text). All
    titles of a document are sought at once, by one automaton, in one pass over
    each page. Items and pages meet by document and run of pages, titles
    first, so a task holds one document's titles and one page, and a long
    document is shared among tasks. An empty title is on every page, a null on none.
    """
    block = lambda page: F.floor(page / PAGES_AT_ONCE).cast("int")
    wanted = items.where("doc_id is not null AND title is not null AND lo <= hi").select("doc_id", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))).alias("block"), F.lit(0).alias("kind"), F.col("list_index").cast("bigint").alias("n"), F.col("title").alias("text"), "lo", "hi")
    there = pages.where("doc_id is not null AND text is not null").select("doc_id", block(F.col("page_no")).alias("block"), F.lit(1).alias("kind"), F.col("page_no").cast("bigint").alias("n"), "text", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    kind = items.schema["doc_id"].dataType.simpleString()
    stream = wanted.unionByName(there).repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "kind", "n")
    return stream.mapInPandas(_searched, f"doc_id {kind}, list_index int, page_no int, ends int")


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import ahocorasick

    now, titles, search = None, {}, None
    for batch in batches:
        out = []
        for doc, block, kind, n, text, lo, hi in batch.itertuples(index=False, name=None):
            if now != (doc, block):
                now, titles, search = (doc, block), {}, None
            if kind == 0:
                titles.setdefault(text, []).append((n, lo, hi))
                continue
            if not titles:
                continue
            if search is None:
                search = ahocorasick.Automaton()
                for t in filter(None, titles):
                    search.add_word(t, t)
                search.make_automaton()
            first = {"": 0} if "" in titles else {}
            for at, t in search.iter(text) if len(search) else ():
                first.setdefault(t, at + 1)
            out += [(doc, i, n, ends) for t, ends in first.items() for i, lo_, hi_ in titles[t] if lo_ <= n <= hi_]
        yield pd.DataFrame(out, columns=["doc_id", "list_index", "page_no", "ends"])


def search_offsets(items: DataFrame, pages: DataFrame, sample: int = 5) -> DataFrame:
    """(doc_id, offset): the commonest distance from a sample title's page to the first page that has it near its start, contents pages left out."""
    first = items.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("list_index"))).where(F.col("rn") <= sample).where("page is not null AND length(title) > 0")
    spans = pages.groupBy("doc_id").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    hits = title_hits(first.join(spans, "doc_id").select("doc_id", "list_index", "title", "lo", "hi"), pages)
    # A page that has three titles of the sample is one of contents.
    near = F.count(F.when(F.col("ends") <= 5000, True)).over(W.partitionBy("doc_id", "page_no"))
    found = hits.withColumn("n", near).where("n < 3 AND ends <= 3000").groupBy("doc_id", "list_index").agg(F.min("page_no").alias("at"))
    votes = found.join(first.select("doc_id", "list_index", "page"), ["doc_id", "list_index"]).groupBy("doc_id", (F.col("at") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"), F.min("list_index").alias("seen"))
    return votes.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", (-F.col("seen")).alias("s"))).alias("offset"))


def pair_offsets(items: DataFrame, answers: DataFrame, start_page: int = 1) -> DataFrame:
    """(doc_id, offset): the commonest difference of pages that share a title; of equals the first seen."""
    pairs = items.join(answers, ["doc_id", "title"]).where(F.col("physical_index") >= start_page)
    votes = pairs.groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"), F.min("list_index").alias("seen"))
    return votes.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", (-F.col("seen")).alias("s"))).alias("offset"))


def neighbour_bounds(items: DataFrame, trusted, last_page) -> DataFrame:
    """Adds prev_page and next_page: the nearest trusted pages on either side."""
    before = W.partitionBy("doc_id").orderBy("list_index").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("doc_id").orderBy("list_index").rowsBetween(1, W.unboundedFollowing)
    page = F.when(trusted, F.col("physical"))
    return items.withColumn("prev_page", F.coalesce(F.last(page, ignorenulls=True).over(before), F.lit(1))).withColumn(
        "next_page", F.coalesce(F.first(page, ignorenulls=True).over(after), last_page)
    )


def relocate(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, list_index, fixed): the first page between an item's bounds that has its title, white space aside; null if none does."""
    keyed = items.select("doc_id", "list_index", T.title_key(F.col("title"), False).alias("title"), F.col("prev_page").alias("lo"), F.col("next_page").alias("hi"))
    hits = title_hits(keyed, pages.select("doc_id", "page_no", T.title_key(F.col("text"), False).alias("text")))
    found = hits.groupBy("doc_id", "list_index").agg(F.min("page_no").alias("fixed"))
    return items.select("doc_id", "list_index").join(found, ["doc_id", "list_index"], "left")


def fill_mapping(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """left with nulls of a column filled from right; right has one row a key."""
    return left.join(right.withColumnRenamed(column, "_new"), keys, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def merge_first_wins(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """The rows of all parts, of equal keys the first by part and order."""
    both = parts[0].withColumn("_part", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("_part", F.lit(n)))
    return both.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("_part", order))).where("_rn = 1").drop("_rn", "_part")


def interpolate(items: DataFrame) -> DataFrame:
    """Adds filled: gaps in physical get evenly spaced pages between their neighbours, or count on from the one before; documents without any page keep none."""
    order = W.partitionBy("doc_id").orderBy("list_index")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    known = F.col("physical").isNotNull()
    df = items.withColumn("rn", F.row_number().over(order))
    for name, f, w in (("a", F.last, before), ("b", F.first, after)):
        df = df.withColumn(f"{name}_page", f(F.when(known, F.col("physical")), ignorenulls=True).over(w)).withColumn(f"{name}_rn", f(F.when(known, F.col("rn")), ignorenulls=True).over(w))
    between = F.col("a_page") + F.floor((F.col("b_page") - F.col("a_page")) * (F.col("rn") - F.col("a_rn")) / (F.col("b_rn") - F.col("a_rn")))
    filled = F.when(known, F.col("physical")).when(F.col("a_page").isNull() & F.col("b_page").isNull(), F.lit(None)).when(F.col("a_page").isNull(), F.greatest(F.lit(1), F.col("b_page") - (F.col("b_rn") - F.col("rn")))).when(F.col("b_page").isNull(), F.col("a_page") + F.col("rn") - F.col("a_rn")).otherwise(between)
    return df.withColumn("filled", filled.cast("int")).drop("rn", "a_page", "b_page", "a_rn", "b_rn")


def shift_duplicates(items: DataFrame, page: str = "physical") -> DataFrame:
    """Adds shifted: of items of a document on one page the first stays, each later one goes to the next page that is free.

    In the order of pages, an item's page is the least that is over the one before: a running maximum of page less place.
    """
    order = W.partitionBy("doc_id").orderBy(page, "list_index")
    known = items.where(F.col(page).isNotNull()).withColumn("_k", F.row_number().over(order))
    shifted = known.withColumn("shifted", (F.col("_k") + F.max(F.col(page) - F.col("_k")).over(order.rowsBetween(W.unboundedPreceding, 0))).cast("int")).drop("_k")
    return shifted.unionByName(items.where(F.col(page).isNull()).withColumn("shifted", F.lit(None).cast("int")))


def backward_steps(items: DataFrame, page: str = "physical") -> DataFrame:
    """(doc_id, list_index, previous, page): items whose page lies before that of the item before, among those with a page."""
    order = W.partitionBy("doc_id").orderBy("list_index")
    known = items.where(F.col(page).isNotNull()).select("doc_id", "list_index", F.lag(page).over(order).alias("previous"), F.col(page).alias("page"))
    return known.where("page < previous")


def sampled_accuracy(items: DataFrame, by: list[str], key: list[str], percent: int, z: float = 1.96) -> DataFrame:
    """(by, sampled, accuracy, low, high): the share of passed items of a sample as Wilson's interval, beside the share of all.

    A row is in the sample by a hash of its key, so every run takes the same
    rows, whatever the partitions; groups of which no row is taken are left out.
    """
    taken = F.conv(F.substring(F.md5(F.concat_ws("-", *key)), 1, 8), 16, 10).cast("bigint") % 100 < percent
    ok = F.col("passed").cast("int")
    own = items.groupBy(*by).agg(F.count(F.when(taken, True)).alias("sampled"), F.avg(ok).alias("accuracy"), F.avg(F.when(taken, ok)).alias("_p")).where("sampled > 0")
    n, p, z2 = F.col("sampled"), F.col("_p"), z * z
    mid, reach, whole = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)), 1 + z2 / n
    return own.select(*by, "sampled", "accuracy", ((mid - reach) / whole).alias("low"), ((mid + reach) / whole).alias("high"))
