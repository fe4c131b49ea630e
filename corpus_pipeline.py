"""The corpus pipeline: five stages from raw documents to packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it. Columns
beside those of ``documents`` are left out.

Defined results of the stages: a null or empty text has no words, so the quality rules
reject it; repeated rows are judged alike and are near-duplicates of each other, so one
stays; rows without a doc_id, or of one doc_id with different texts, are documents of their
own up to packing; the substring stage takes no words from rows without a doc_id, nor
between rows of one; an empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, packing, quality, recompress, secrets
from tidemark.llm._common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of documents with ``text`` where ``changed``."""
    new = {"text": F.when(changed, text).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines that break a rule."""
    q = quality.kept_documents(docs.select(*COLUMNS))
    return _with_text(q, F.col("quality.clean_text"), F.col("quality.n_removed_lines") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one with the least doc_id, null last.

    A row is known by a hash of doc_id and text, so rows without a doc_id, and rows
    that share one but differ in text, are documents of their own.
    """
    docs = docs.select(*COLUMNS).withColumn("__row", F.xxhash64("doc_id", "text"))
    classes = Workspace(spark, "classes").save(bagminhash.near_duplicate_classes(docs, id_col="__row"), "classes")
    classes = classes.groupBy(F.col("doc_id").alias("__row")).agg(F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    ids = docs.groupBy("__row").agg(F.min("doc_id").alias("id"))
    least = F.min(F.struct(F.col("id").isNull(), "id", "__row", "n"))
    firsts = Workspace(spark, "firsts").save(classes.join(ids, "__row").groupBy("class_id").agg(least.alias("c")).select("c.__row", "c.n"), "firsts")
    # only rows that are repeated are grouped, so a repeat anywhere does not move all texts again
    once = docs.join(firsts.where("n = 1").select("__row").hint("merge"), "__row").select(*COLUMNS)
    again = firsts.where("n > 1").select("__row")
    if again.isEmpty():
        return once
    repeated = docs.join(again, "__row").groupBy("__row").agg(F.min(F.struct(*COLUMNS)).alias("c")).select("c.*")
    return once.unionByName(repeated)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a document that loses all its words goes as well."""
    return recompress.without_repeats(docs.select(*COLUMNS)).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), redacted=True)
    return _with_text(found, F.col("secrets.redacted"), F.col("secrets.redacted").isNotNull())


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack_batches),
]

#: SQL cannot express the stages (near-duplicate classes, token ratios, the packing program); see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.save(docs, name)
    return docs
