"""Documents to packed training sequences: the stages of the corpus pipeline, one after another.

Each stage takes all that its predecessor kept and returns the columns of documents, but for the last, which returns pieces with
their place in a sequence. run() writes every stage to the shared folder before the next reads it.

Decisions are about rows, not ids: a row is known by the 64-bit hash of its id and text (`_marked`), so rows that share an id, or have none,
stay or go each on their own text. Null and empty texts fail the quality rules; of rows equal in id and text one stays; very long
texts take part whole; columns that documents have besides pass through; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm import op1_secret_scans, op5_decontamination, op6_jaccard_join, op8_packing, op9_quality_rules
from logsignals.llm.textual import saved, table

#: Near duplicates here: five words a shingle, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Marks up to which they are broadcast as a filter (some 50 MB); beyond, a shuffled join.
BROADCAST_MARKS = 1_000_000


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_mark", F.xxhash64("doc_id", "text"))


def _which(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose mark is (left_semi) or isn't (left_anti) among marks(_mark), a saved table."""
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks
    return _marked(docs).join(marks, "_mark", how).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive fences keep."""
    limits = saved(op9_quality_rules.fences(op9_quality_rules.sketches(op9_quality_rules.features(docs))))
    return op9_quality_rules.judged(op9_quality_rules.features(docs), limits).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without words stay."""
    rows = saved(op6_jaccard_join.jaccard_members(_marked(docs).select("doc_id", F.col("_mark").alias("mark"), "text"), SHINGLE, PERCENT).filter("label IS NOT NULL"))
    first = saved(rows.groupBy("label").agg(F.min_by("mark", F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("stays")))
    goes = saved(rows.join(first, "label").filter("mark <> stays").select(F.col("mark").alias("_mark")).distinct())
    kept = _which(docs, goes, "left_anti")
    again = saved(rows.groupBy(F.col("mark").alias("_mark")).agg(F.count("*").alias("n")).filter("n > 1").select("_mark"))
    if again.isEmpty():
        return kept
    one = _marked(_which(kept, again, "left_semi")).dropDuplicates(["_mark"]).select(*docs.columns)
    return _which(kept, again, "left_anti").unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = op5_decontamination.contained_rows(_marked(docs).select("doc_id", F.col("_mark").alias("mark"), "text"), table(spark, sf_dir, "benchmark"))
    return _which(docs, saved(leaks.select(F.col("mark").alias("_mark")).distinct()), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark."""
    return op1_secret_scans.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it."""
    return op8_packing.pack(docs, public_tokenizers.path(op8_packing.VOCABULARY))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
