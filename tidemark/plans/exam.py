"""Projects the driver's tables onto exams, questions and their audits.

A synthetic projection: sixty customers are an exam, thirty of them listening and
thirty reading; orders are review records; an exam's orders of one year are a run, line
numbers are passes, return flags verdicts, and returned lines findings. The third pass
takes listening questions only. So every document that is built for an exam, run or
pass holds sixty questions at most, however large the tables are.

``SQL`` holds the same relations for DuckDB; a query's SQL begins with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import table

SIZE, LISTENING = 60, 30
#: Passes audit from one of these perspectives; the one named first takes listening questions only.
ALIGNMENT = "transcript_alignment"


def questions(spark: SparkSession, d: str) -> DataFrame:
    number = F.expr(f"cast(c_custkey % {SIZE} + 1 as int)")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.expr(f"c_custkey div {SIZE}").alias("exam_id"),
        number.alias("number"),
        F.when(number <= LISTENING, "listening").otherwise("reading").alias("section"),
        F.expr("cast(2 + c_custkey % 3 as int)").alias("points"),
        F.col("c_name").alias("stem"),
        (F.col("c_nationkey") == 7).alias("requires_image"),
        F.when(F.col("c_mktsegment") == "BUILDING", "verified").when(F.col("c_mktsegment") == "MACHINERY", "rejected").otherwise("needs_manual_review").alias("status"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )


def choices(q: DataFrame) -> DataFrame:
    blank = F.col("requires_image") & (F.col("choice") == 4)
    rows = q.select("subject_id", "stem", "requires_image", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("choice"))
    return rows.select("subject_id", "choice", F.when(blank, "").otherwise(F.concat_ws(":", "stem", "choice")).alias("text"))


def answers(q: DataFrame) -> DataFrame:
    return q.select("subject_id", F.expr("cast(subject_id % 4 + 1 as int)").alias("choice_number"), (F.col("nation") != 3).alias("agree"), F.expr("cast(number div 10 + 1 as int)").alias("answer_page"))


def groups(q: DataFrame) -> DataFrame:
    """Groups of ten questions; the sixth of an exam is not described, so its questions have none."""
    rows = q.select("exam_id", F.expr("(number - 1) div 10").alias("g")).distinct().where("g < 5")
    return rows.select("exam_id", "g", F.when(F.expr("g % 2 = 0"), F.concat(F.lit("Group "), F.col("g"))).alias("instruction"), (F.col("g") * 10 + 1).cast("int").alias("first_number"), (F.col("g") * 10 + 10).cast("int").alias("last_number"))


def transcripts(q: DataFrame) -> DataFrame:
    warnings = F.when(F.col("nation") == 9, "oops").when(F.col("number") >= 25, '["shared"]').otherwise("[]")
    return q.where("section = 'listening'").select("subject_id", F.concat(F.lit("A: "), F.col("stem")).alias("dialogue"), F.when(F.col("nation") == 5, "needs_manual_review").otherwise(F.col("status")).alias("transcript_status"), warnings.alias("warnings_json"))


def images(q: DataFrame) -> DataFrame:
    keys = F.array(F.expr("concat('img-', subject_id % 97)"), F.expr("concat('img-', 100 + subject_id % 89)"))
    return q.where("requires_image").select("subject_id", F.explode(keys).alias("image_key"))


def assets(q: DataFrame) -> DataFrame:
    exam = F.col("exam_id")
    return q.select("exam_id").distinct().select(exam, F.when(exam % 7 != 3, 600 + (exam % 50) * 0.5).alias("duration_seconds"), F.sha2(exam.cast("string"), 256).alias("source_sha256"))


def segments(q: DataFrame) -> DataFrame:
    start = F.col("number") * 10000
    rows = q.where("section = 'listening' and balance > 0")
    return rows.select(
        "subject_id", "exam_id", "number", start.alias("start_ms"), (start + 500 + F.round("balance").cast("int")).alias("end_ms"),
        F.when(F.expr("nation % 2 = 0"), "verified").otherwise("candidate").alias("segment_status"), F.expr("1 + nation % 3").alias("version"),
        F.when(F.expr("nation % 4 = 0"), F.concat(F.lit("clip-"), F.col("subject_id"))).alias("clip"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    """Review records; the evidence of some is no JSON."""
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "rejected").otherwise("needs_manual_review")
    evidence = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority")).otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("note"))))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), status.alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "import").otherwise("manual_question_review").alias("scope"), evidence.alias("evidence"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reviewed_at"))


def audits(spark: SparkSession, d: str) -> DataFrame:
    """One row for a run, pass and subject: scope, verdict where the pass is done, and findings.

    All audit relations come from this one aggregate, so orders and lines are joined once,
    and reports by run and subject group the rows where they are. ``found`` has a
    fingerprint once, with the worst severity and the first id.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).where(f"l_linenumber <> 3 or o_custkey % {SIZE} < {LISTENING}")
    cents = F.round(F.col("l_discount") * 100).cast("int")
    score = F.when(cents >= 9, 90).when(cents >= 6, 65).when(cents >= 3, 35).otherwise(15)
    line = F.struct(F.pmod("l_partkey", F.lit(5)).cast("int").alias("kind"), score.alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occ_id"))
    exam, y = F.expr(f"o_custkey div {SIZE}"), F.col("y").cast("string")
    rows = rows.select(
        exam.alias("exam_id"), F.concat(F.lit("run-"), y, F.lit("-e"), exam).alias("run_id"), F.concat(y, F.lit("-01-01T00:00:00Z")).alias("created_at"), F.col("l_linenumber").cast("int").alias("pass_number"),
        F.col("o_custkey").alias("subject_id"), (F.pmod(F.col("y") + F.col("l_linenumber"), F.lit(7)) != 0).alias("completed"), F.col("l_returnflag").alias("flag"), line.alias("line"),
    )
    rank = F.max(F.when(F.col("flag") == "R", 2).when(F.col("flag") == "A", 1).otherwise(0))
    lines = F.collect_list(F.when(F.expr("completed and flag = 'R'"), F.col("line")))
    out = rows.repartition("run_id", "subject_id").groupBy("exam_id", "run_id", "created_at", "pass_number", "subject_id", "completed").agg(F.element_at(F.array(F.lit("clear"), F.lit("uncertain"), F.lit("finding")), rank + 1).alias("verdict"), lines.alias("lines"))

    def finding(kind):
        own = F.filter("lines", lambda x: x["kind"] == kind)
        occ_id = F.array_min(F.transform(own, lambda x: x["occ_id"]))
        return F.struct(
            F.sha2(F.concat_ws(":", F.col("subject_id").cast("string"), kind.cast("string")), 256).alias("fingerprint"), F.array_max(F.transform(own, lambda x: x["score"])).alias("score"), occ_id.alias("occ_id"), kind.alias("kind"),
            F.concat(F.lit("kind-"), kind).alias("category"), F.concat(F.lit("s-"), occ_id).alias("summary"), F.concat(F.lit("auditor-"), F.col("pass_number")).alias("auditor"),
        )

    found = F.transform(F.array_distinct(F.transform("lines", lambda x: x["kind"])), finding)
    return out.withColumns({"verdict": F.when(F.col("completed"), F.col("verdict")), "found": found}).drop("lines")


def occurrences(a: DataFrame) -> DataFrame:
    """One row for a fingerprint and pass."""
    return a.select("exam_id", "run_id", "created_at", "pass_number", "subject_id", F.explode("found").alias("f")).select("exam_id", "run_id", "created_at", "pass_number", "subject_id", "f.*")


SQL = f"""WITH q AS (
  SELECT c_custkey AS subject_id, c_custkey // {SIZE} AS exam_id, (c_custkey % {SIZE} + 1)::INT AS number, CASE WHEN c_custkey % {SIZE} < {LISTENING} THEN 'listening' ELSE 'reading' END AS section,
    (2 + c_custkey % 3)::INT AS points, c_name AS stem, c_nationkey = 7 AS requires_image, CASE c_mktsegment WHEN 'BUILDING' THEN 'verified' WHEN 'MACHINERY' THEN 'rejected' ELSE 'needs_manual_review' END AS status,
    c_nationkey AS nation, c_acctbal AS balance FROM customer
), ch AS (SELECT subject_id, choice::INT AS choice, CASE WHEN requires_image AND choice = 4 THEN '' ELSE stem || ':' || choice END AS text FROM q, range(1, 5) AS r(choice)),
an AS (SELECT subject_id, (subject_id % 4 + 1)::INT AS choice_number, nation <> 3 AS agree, (number // 10 + 1)::INT AS answer_page FROM q),
gr AS (SELECT exam_id, g, CASE WHEN g % 2 = 0 THEN 'Group ' || g END AS instruction, (g * 10 + 1)::INT AS first_number, (g * 10 + 10)::INT AS last_number FROM (SELECT DISTINCT exam_id, (number - 1) // 10 AS g FROM q) WHERE g < 5),
tr AS (SELECT subject_id, 'A: ' || stem AS dialogue, CASE WHEN nation = 5 THEN 'needs_manual_review' ELSE status END AS transcript_status, CASE WHEN nation = 9 THEN 'oops' WHEN number >= 25 THEN '["shared"]' ELSE '[]' END AS warnings_json FROM q WHERE section = 'listening'),
im AS (SELECT subject_id, 'img-' || unnest([subject_id % 97, 100 + subject_id % 89]) AS image_key FROM q WHERE requires_image),
asst AS (SELECT DISTINCT exam_id, CASE WHEN exam_id % 7 <> 3 THEN (600 + (exam_id % 50) * 0.5)::DOUBLE END AS duration_seconds, sha256(exam_id::VARCHAR) AS source_sha256 FROM q),
seg AS (SELECT subject_id, exam_id, number, number * 10000 AS start_ms, number * 10000 + 500 + round(balance)::INT AS end_ms, CASE WHEN nation % 2 = 0 THEN 'verified' ELSE 'candidate' END AS segment_status, 1 + nation % 3 AS version, CASE WHEN nation % 4 = 0 THEN 'clip-' || subject_id END AS clip FROM q WHERE section = 'listening' AND balance > 0),
rec AS (SELECT o_orderkey AS id, o_custkey AS subject_id, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'rejected' ELSE 'needs_manual_review' END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'import' ELSE 'manual_question_review' END AS scope, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS note, strftime(o_orderdate, '%Y-%m-%d') AS reviewed_at FROM orders),
al AS (
  SELECT o_custkey // {SIZE} AS exam_id, 'run-' || year(o_orderdate) || '-e' || (o_custkey // {SIZE}) AS run_id, year(o_orderdate) || '-01-01T00:00:00Z' AS created_at, l_linenumber::INT AS pass_number, o_custkey AS subject_id,
    l_returnflag AS flag, (l_partkey % 5)::INT AS kind, round(l_discount * 100)::INT AS cents, l_orderkey * 10 + l_linenumber AS occ_id, (year(o_orderdate) + l_linenumber) % 7 <> 0 AS completed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 3 OR o_custkey % {SIZE} < {LISTENING}
), sc AS (SELECT DISTINCT exam_id, run_id, created_at, pass_number, subject_id, completed FROM al),
vd AS (SELECT exam_id, run_id, created_at, pass_number, subject_id, CASE max(CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) WHEN 2 THEN 'finding' WHEN 1 THEN 'uncertain' ELSE 'clear' END AS verdict FROM al WHERE completed GROUP BY ALL),
oc AS (
  SELECT exam_id, run_id, created_at, pass_number, subject_id, kind, sha256(subject_id || ':' || kind) AS fingerprint, max(CASE WHEN cents >= 9 THEN 90 WHEN cents >= 6 THEN 65 WHEN cents >= 3 THEN 35 ELSE 15 END) AS score,
    min(occ_id) AS occ_id, 'kind-' || kind AS category, 's-' || min(occ_id) AS summary, 'auditor-' || pass_number AS auditor
  FROM al WHERE completed AND flag = 'R' GROUP BY exam_id, run_id, created_at, pass_number, subject_id, kind
)
"""
