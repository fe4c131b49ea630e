"""Projects the driver's star-schema tables onto the audit relations.

A synthetic projection: years of orders are runs, line numbers are passes, customers
are subjects, return flags are verdicts, and returned lines are findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.concat(F.lit("run-"), F.col("y").cast("string")).alias("run_id"),
        F.concat(F.col("y").cast("string"), F.lit("-01-01T00:00:00Z")).alias("created_at"),
        F.col("l_linenumber").cast("int").alias("pass_number"),
        F.col("o_custkey").alias("subject_id"),
        F.col("l_returnflag").alias("flag"),
        F.pmod("l_partkey", F.lit(5)).cast("int").alias("kind"),
        F.round(F.col("l_discount") * 100).cast("int").alias("cents"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occ_id"),
        (F.pmod(F.col("y") + F.col("l_linenumber"), F.lit(7)) != 0).alias("completed"),
    )


def scope(ls: DataFrame) -> DataFrame:
    """run_id, created_at, pass_number, subject_id, completed: the frozen scope of each pass."""
    return ls.select("run_id", "created_at", "pass_number", "subject_id", "completed").distinct()


def verdicts(ls: DataFrame) -> DataFrame:
    """One verdict for a subject of a completed pass."""
    rank = F.max(F.when(F.col("flag") == "R", 2).when(F.col("flag") == "A", 1).otherwise(0))
    return ls.where("completed").groupBy("run_id", "created_at", "pass_number", "subject_id").agg(F.element_at(F.array(F.lit("clear"), F.lit("uncertain"), F.lit("finding")), rank + 1).alias("verdict"))


def occurrences(ls: DataFrame) -> DataFrame:
    """Findings of completed passes, one for a fingerprint and pass, with the worst severity."""
    score = F.when(F.col("cents") >= 9, 90).when(F.col("cents") >= 6, 65).when(F.col("cents") >= 3, 35).otherwise(15)
    rows = ls.where("completed and flag = 'R'").withColumn("fingerprint", fingerprint(F.col("subject_id"), F.col("kind")))
    return rows.groupBy("run_id", "created_at", "pass_number", "subject_id", "fingerprint").agg(F.max(score).alias("score"), F.min("occ_id").alias("occ_id"), F.min(F.concat(F.lit("kind-"), F.col("kind").cast("string"))).alias("category"))


def passes(ls: DataFrame) -> DataFrame:
    """One row for a run, pass and subject: the verdict where the pass is done, and its returned lines.

    The rows are dealt by run and subject once, and every report by run and subject groups
    them where they are.
    """
    score = F.when(F.col("cents") >= 9, 90).when(F.col("cents") >= 6, 65).when(F.col("cents") >= 3, 35).otherwise(15)
    rank = F.max(F.when(F.col("flag") == "R", 2).when(F.col("flag") == "A", 1).otherwise(0))
    verdict = F.when(F.col("completed"), F.element_at(F.array(F.lit("clear"), F.lit("uncertain"), F.lit("finding")), rank + 1))
    found = F.collect_list(F.when(F.expr("completed and flag = 'R'"), F.struct(fingerprint(F.col("subject_id"), F.col("kind")).alias("fingerprint"), score.alias("score"), "occ_id", F.concat(F.lit("kind-"), F.col("kind").cast("string")).alias("category"))))
    keys = ["run_id", "created_at", "pass_number", "subject_id", "completed"]
    return ls.repartition("run_id", "subject_id").groupBy(*keys).agg(verdict.alias("verdict"), found.alias("found"))


def fingerprint(subject: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws(":", subject.cast("string"), kind.cast("string")), 256)


#: The same relations for DuckDB; a query's SQL begins with this prefix.
SQL = """
WITH lines AS (
  SELECT 'run-' || year(o_orderdate) AS run_id, year(o_orderdate) || '-01-01T00:00:00Z' AS created_at,
    l_linenumber::INT AS pass_number, o_custkey AS subject_id, l_returnflag AS flag, (l_partkey % 5)::INT AS kind,
    round(l_discount * 100)::INT AS cents, l_orderkey * 10 + l_linenumber AS occ_id,
    (year(o_orderdate) + l_linenumber) % 7 <> 0 AS completed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), scope AS (SELECT DISTINCT run_id, created_at, pass_number, subject_id, completed FROM lines),
verdicts AS (
  SELECT run_id, created_at, pass_number, subject_id,
    CASE max(CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) WHEN 2 THEN 'finding' WHEN 1 THEN 'uncertain' ELSE 'clear' END AS verdict
  FROM lines WHERE completed GROUP BY ALL
), occurrences AS (
  SELECT run_id, created_at, pass_number, subject_id, sha256(subject_id || ':' || kind) AS fingerprint,
    max(CASE WHEN cents >= 9 THEN 90 WHEN cents >= 6 THEN 65 WHEN cents >= 3 THEN 35 ELSE 15 END) AS score,
    min(occ_id) AS occ_id, min('kind-' || kind) AS category
  FROM lines WHERE completed AND flag = 'R' GROUP BY run_id, created_at, pass_number, subject_id, fingerprint
)
"""
