"""From raw documents to packed training sequences.

Toxic documents go, one document of each group of near-duplicates stays, sources are mixed to their target weights, and
what the mix takes is packed. Each stage reads all that its predecessor kept; all but the last return the columns of the
documents, whichever these are beside doc_id, text and source.

Defined cases, for all stages. A null or empty text is a document without words: no stage but the mix, which repeats or
leaves out documents by their words, changes how often it occurs, and packing gives it its end token. Very long texts are
whole. A null doc_id is kept through all stages. Rows that repeat a doc_id are documents of their own for toxicity, mixing
and packing; for near-duplicates they are one document whose texts are one group. Of a group the row with the smallest
doc_id stays (null last; ties: the text with the smaller hash, then the least of the other columns). An empty table gives
an empty result. Columns whose names clash with those that operators add are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillflow.llm import toxicity
from stillflow.llm.common import scratch, table, written
from stillflow.llm.mixing import mixed_rows
from stillflow.llm.near_dup import near_duplicates
from stillflow.llm.packing import pack_documents

#: SQL cannot express the learned lexicon, the mix's order or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels of these documents, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), model)
    return scored.filter("predicted = 0").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all documents without words.

    Rows are found again by doc_id and a hash of their text, so that a kept row without an id keeps no other.
    """
    found = near_duplicates(docs)
    grouped = found.filter("group_id is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("k")
    stays = grouped.groupBy("group_id").agg(first).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    rows = grouped.groupBy(F.col("doc_id").alias("_id2"), F.col("text_hash").alias("_hash2")).agg(F.count("*").alias("_n"))
    stays = stays.join(rows, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))).select("_id", "_hash", "_n")
    bare = found.filter("group_id is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(1).alias("_n")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    once = keyed.join(stays.filter("_n = 1").unionByName(bare), same, "left_semi").select("_row")
    # Of rows that are equal in both, the first of a fixed order.
    order = Window.partitionBy("_doc", "_text").orderBy(*(F.col("_row")[c] for c in docs.columns))
    again = keyed.join(stays.filter("_n > 1"), same, "left_semi").withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("_row")
    return once.unionByName(again).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document; the text (and n_chars, if there is one) of the last of a source may be cut."""
    mixed = mixed_rows(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.when(F.length("text") < F.col("n_chars"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of sf_dir. A stage's working tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
