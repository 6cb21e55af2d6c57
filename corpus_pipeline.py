"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and tokens, in this order.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and empty
tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm import line_dedup, mixing, sentencepiece_lattice, simhash, toxicity
from larder.llm.common import cut, fresh, table, text_or_empty

#: Wanted shares of expected tokens; documents are repeated to reach them and none is dropped.
MIX = {"good": 0.88, "poor": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, "score"), fresh(docs, "predicted")
    return toxicity.score(docs, model, names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text."""
    clean = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        removed = line_dedup.count_names(docs)[1]
        clean = clean.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by SimHash one row stays: that of smallest doc_id, of its texts the one of smallest hash.

    Texts are told apart by doc_id and content, so a doc_id with two texts keeps the one of each group that stays.
    Rows without a doc_id can't be told apart by it and stay.
    """
    copy, content = fresh(docs, "copy_no"), fresh(docs, "content_hash")
    groups = simhash.similar_documents(docs).where("doc_id IS NOT NULL")
    stays = groups.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("kept")).select("kept.doc_id", F.col("kept.content").alias(content))
    same = Window.partitionBy("doc_id", content).orderBy("doc_id")
    told = docs.withColumn(content, F.xxhash64(text_or_empty())).join(stays, ["doc_id", content], "left_semi")
    first = told.withColumn(copy, F.row_number().over(same))
    return first.where(F.col(copy) == 1).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains under their target are repeated."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX, min_rate=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.load_model())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate_lines), ("simhash_dedup", keep_one_of_each_group),
          ("mixing", mix_to_targets), ("sentencepiece", tokens)]

#: Trained models and merge-order tokens have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is materialised before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
