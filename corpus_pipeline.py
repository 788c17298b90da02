"""A corpus from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafspan.llm import common, decontam, line_dedup, pieces, quality_model, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, null and empty texts judged like any other; repeated rows stay or go alike."""
    model = quality_model.train(docs, common.table(spark, sf_dir, "labels"))
    return unpacked(quality_model.scored(docs, model).where("predicted = 1"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier ones have; those of which nothing is left go."""
    clean = line_dedup.line_dedup(docs)
    left = clean.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return left.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, key): all of a row in one struct, and a key that tells rows of different ids or texts apart; a null id is one of its own."""
    named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    key = F.concat(F.md5(F.coalesce("text", F.lit(""))), F.when(F.col("text").isNull(), "0").otherwise("1"), named)
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", key.alias("key"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, whatever they are called."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8), the one of the smallest id (null ids last), then of the smallest key.

    Null and blank texts are one group. Rows that repeat id and text are one document, of which one row stays.
    """
    rows = packed(docs)
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key").alias("named"), "text")
    groups = simhash.similar_documents(named, shingle=5, similarity=0.8, id_col="named")
    first = groups.select(F.col("component_id.key").alias("key")).distinct()
    return unpacked(rows.join(first, "key", "left_semi").dropDuplicates(["key"]), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those of null ids are judged by their texts like all others, and repeated rows alike."""
    rows = packed(docs)
    found = decontam.contamination(rows.select("key", "text"), common.table(spark, sf_dir, "benchmark"), id_col="key")
    return unpacked(rows.join(found.where("contaminated").select(F.col("id").alias("key")).distinct(), "key", "left_anti"), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_tokens),
]

#: Boosted tables, SimHash and a tokenizer have no form in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, with every other stage written below the shared checkpoint folder."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
