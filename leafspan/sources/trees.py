"""Section trees as nested JSON, in and out; the reader unrolls them to a depth that is its parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as S

from leafspan.operators import hierarchy as H


ROWS = "array<struct<path:array<int>,depth:int,node_id:string,title:string,start_page:int,end_page:int>>"


def tree_schema(depth: int = 4) -> S.StructType:
    """A node with every accepted key, its children unrolled to a depth."""
    fields = [S.StructField(k, S.StringType()) for k in ("title", "node_id", "id", "summary")]
    fields += [S.StructField(k, S.IntegerType()) for k in ("start_index", "end_index", "ps", "pe", "page_start", "page_end")]
    if depth > 1:
        fields.append(S.StructField("children", S.ArrayType(tree_schema(depth - 1))))
    return S.StructType(fields)


def read_trees(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """(doc, path, depth, node_id, title, start_page, end_page) of one JSON tree a file."""
    return flat_trees(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value"), "doc", depth)


def flat_trees(text: DataFrame, key: str, depth: int = 4) -> DataFrame:
    """(key, path, depth, node_id, title, start_page, end_page) of JSON trees (key, value).

    A tree is {structure: [..]}, {children: [..]}, {result: {structure: [..]}} or
    a list of nodes. One pass: every node gives itself and all below it, and one
    generator makes rows of a tree's nodes. A union of levels would read the input
    once a level, all in the tasks of one stage.
    """
    # Children go by two names: made one first, as the schema would double with every level.
    text = text.select(F.col(key).alias("doc"), F.regexp_replace("value", r'(?<!\\\\)"nodes"\s*:', '"children":').alias("value"))
    many = S.ArrayType(tree_schema(depth))
    wrapped = S.StructType([S.StructField("structure", many), S.StructField("children", many), S.StructField("result", S.StructType([S.StructField("structure", many)]))])
    w = F.from_json("value", wrapped)
    roots = F.when(F.ltrim("value").startswith("["), F.from_json("value", many)).otherwise(F.coalesce(w["structure"], w["children"], w["result"]["structure"]))
    nodes = _with_all_below(roots, F.array().cast("array<int>"), 1, depth)
    return text.select(F.col("doc").alias(key), F.inline(nodes))


def _with_all_below(nodes: Column, above: Column, level: int, depth: int) -> Column:
    """The nodes of an array and all below them to a depth, in preorder; above is the path of their parent."""

    def unrolled(n: Column, place: Column) -> Column:
        path = F.concat(above, F.array(place))
        own = F.struct(
            path.alias("path"), F.lit(level).alias("depth"), F.coalesce(n["node_id"], n["id"]).alias("node_id"), n["title"].alias("title"),
            F.coalesce(n["start_index"], n["ps"], n["page_start"]).alias("start_page"), F.coalesce(n["end_index"], n["pe"], n["page_end"]).alias("end_page"),
        )
        if level == depth:
            return F.array(own)
        below = _with_all_below(n["children"], path, level + 1, depth)
        return F.concat(F.array(own), F.coalesce(below, F.array().cast(ROWS)))

    return F.flatten(F.transform(nodes, unrolled))


def nested_trees(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(doc_id, tree): the API's JSON layout, of any depth.

    Every node is written in preorder, with the brackets that it opens or that end
    with it, and a document's parts are put together: one pass, no join.
    """
    head = F.to_json(F.struct(F.col("node_id").alias("id"), "title", F.col("start_page").alias("ps"), F.col("end_page").alias("pe")))
    df = H.paths(nodes, max_depth, "pre", "_path").select("doc_id", "pre", head.alias("head"), F.size("_path").alias("level"))
    df = df.withColumn("above", F.lag("level").over(H.by_doc())).withColumn("below", F.lead("level").over(H.by_doc()))
    opens = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"children":['))
    closes = F.concat("head", F.repeat(F.lit("]}"), F.col("level") - F.coalesce("below", F.lit(1))))
    part = F.concat(F.when(F.col("above") >= F.col("level"), ",").otherwise(""), F.when(F.col("below") > F.col("level"), opens).otherwise(closes))
    parts = F.sort_array(F.collect_list(F.struct("pre", part.alias("part"))))
    return df.groupBy("doc_id").agg(F.concat(F.lit('{"id":"root","children":['), F.array_join(F.transform(parts, lambda x: x["part"]), ""), F.lit("]}")).alias("tree"))


def write_trees(trees: DataFrame, path: str) -> None:
    trees.write.mode("errorifexists").json(path)


def with_bucket(df: DataFrame, key: str = "doc_id", buckets: int = 16) -> DataFrame:
    """df with the bucket of its key, and pending for the status of rows that have none."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return out.withColumn("status", F.coalesce("status", F.lit("pending"))) if "status" in df.columns else out


def append_rows(df: DataFrame, path: str, key: str = "doc_id", buckets: int = 16) -> None:
    """Appends to a table that is partitioned by a bucket of its key."""
    with_bucket(df, key, buckets).write.mode("append").partitionBy("bucket").parquet(path)
