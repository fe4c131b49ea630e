"""Consensus, risk, convergence and history over independent audit passes.

Every operator computes all runs and subjects in one plan, most from one relation
``passes`` (see ``run_consensus``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import presence
from tidemark.operators.numbering import numbered

VERDICTS = ("clear", "finding", "uncertain")
#: Severity scores and the thresholds of risk levels.
SEVERITY = {"low": 15, "medium": 35, "high": 65, "critical": 90}
LEVELS = ((90, "critical"), (70, "high"), (40, "medium"))


def severity_name(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in SEVERITY.items():
        out = F.when(score == value, name).otherwise(out)
    return out


def risk_level(score: Column, none_at_zero: bool = True) -> Column:
    out = F.when(score > 0, "low").otherwise("none") if none_at_zero else F.lit("low")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def verdict_totals(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Counts of each verdict, zero-filled."""
    return verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def _items(passes: DataFrame) -> DataFrame:
    """Per run and subject, its passes counted and the findings of them all in one list, which is as long as a subject has findings."""
    item = F.transform("found", lambda x: F.struct(F.col("pass_number").alias("pass_number"), x["fingerprint"].alias("fingerprint"), x["score"].alias("score"), x["occ_id"].alias("occ_id"), x["category"].alias("category")))
    return passes.groupBy("run_id", "subject_id", "created_at").agg(
        F.count(F.lit(1)).alias("pass_total"), F.count("verdict").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.flatten(F.collect_list(item)).alias("items")
    )


def _per_finding(items: Column) -> Column:
    """(fingerprint, n passes, worst score, first category) of each finding of a list of items."""

    def one(fingerprint: Column) -> Column:
        own = F.filter(items, lambda x: x["fingerprint"] == fingerprint)
        first = F.array_min(F.transform(own, lambda x: F.struct(x["occ_id"].alias("occ_id"), x["category"].alias("category"))))
        n = F.size(F.array_distinct(F.transform(own, lambda x: x["pass_number"])))
        return F.struct(fingerprint.alias("fingerprint"), n.alias("n"), F.array_max(F.transform(own, lambda x: x["score"])).alias("top"), first["category"].alias("category"))

    return F.transform(F.array_distinct(F.transform(items, lambda x: x["fingerprint"])), one)


def run_consensus(passes: DataFrame) -> DataFrame:
    """Per run and fingerprint: agreement among eligible completed passes, and risk.

    ``passes``: a row for a run, pass and subject of its scope, with created_at, completed,
    verdict (null while the pass is open) and found, an array of (fingerprint, score, occ_id,
    category). A finding that a pass lists twice counts once, with its worst score.
    """
    rows = _items(passes).select("run_id", "subject_id", F.col("total").alias("eligible"), F.explode(_per_finding(F.col("items"))).alias("f"))
    n, top = F.col("f.n").cast("long"), F.col("f.top")
    score = F.least(F.lit(100), top + (n - 1) * 10)
    ratio = F.when(F.col("eligible") > 0, F.bround(n / F.col("eligible"), 4)).otherwise(0.0)
    return rows.select("run_id", "subject_id", "f.fingerprint", "f.category", n.alias("consensus_count"), "eligible", ratio.alias("ratio"), severity_name(top).alias("max_severity"), score.cast("long").alias("risk_score"), risk_level(score, False).alias("risk_level"))


def question_summary(passes: DataFrame) -> DataFrame:
    """Per run and subject: verdict totals, disagreement, risk and execution counts."""
    rows = _items(passes).where("total > 0").withColumn("f", _per_finding(F.col("items")))
    zero = F.lit(0)
    best = lambda name: F.coalesce(F.array_max(F.transform("f", lambda x: x[name])), zero)
    rows = rows.withColumns({"top": best("top"), "recurrence": best("n")})
    disagreement = sum(((F.col(v) > 0).cast("int") for v in VERDICTS[1:]), (F.col(VERDICTS[0]) > 0).cast("int")) > 1
    risk = F.col("top") + F.when(F.col("recurrence") > 1, F.least(F.lit(20), (F.col("recurrence") - 1) * 10)).otherwise(0) + F.when(disagreement, 15).otherwise(0) + F.least(F.lit(10), F.col("uncertain") * 5)
    rows = rows.withColumn("risk_score", F.least(F.lit(100), risk).cast("long"))
    verdict = F.when(F.col("finding") > 0, "finding").when(F.col("uncertain") > 0, "uncertain").otherwise("clear")
    return rows.select("run_id", "subject_id", verdict.alias("verdict"), "total", *VERDICTS, disagreement.alias("disagreement"), "risk_score", risk_level(F.col("risk_score")).alias("risk_level"), F.size("f").cast("long").alias("n_findings"), "pass_total", F.col("total").alias("completed_passes"))


def _prints() -> Column:
    return F.transform("found", lambda x: x["fingerprint"])


def _newest_first() -> Column:
    return F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("created_at"), F.desc("run_id")))


def run_presence(passes: DataFrame) -> DataFrame:
    """Per run and subject: completeness, verdict set and fingerprints, ranked newest first."""
    rows = passes.groupBy("run_id", "subject_id", "created_at").agg(F.count(F.lit(1)).alias("pass_total"), F.count("verdict").alias("n"), F.array_sort(F.collect_set("verdict")).alias("verdicts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_prints())))).alias("fingerprints"))
    rows = rows.select("run_id", "subject_id", "created_at", "pass_total", "n", F.when(F.col("n") > 0, F.col("verdicts")).alias("verdicts"), "fingerprints", (F.col("n") == F.col("pass_total")).alias("complete"))
    return rows.withColumn("rank", _newest_first())


def latest_run_per_subject(rows: DataFrame) -> DataFrame:
    """The newest run of each subject; ties of created_at go to the greater run id."""
    return rows.groupBy("subject_id").agg(F.max(F.struct("created_at", "run_id")).alias("m")).select("subject_id", "m.created_at", "m.run_id")


def within_run_novelty(verdicts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Per completed pass: fingerprints, and those that no earlier pass of the run had."""
    first = occurrences.withColumn("first", F.min("pass_number").over(Window.partitionBy("run_id", "fingerprint")))
    counts = first.groupBy("run_id", "pass_number").agg(F.count_distinct("fingerprint").alias("finding_count"), F.count_distinct(F.when(F.col("first") == F.col("pass_number"), F.col("fingerprint"))).alias("new_finding_count"))
    zero = F.lit(0).cast("long")
    return verdicts.select("run_id", "pass_number").distinct().join(counts, ["run_id", "pass_number"], "left").select("run_id", "pass_number", F.coalesce("finding_count", zero).alias("finding_count"), F.coalesce("new_finding_count", zero).alias("new_finding_count"))


def pass_jaccard(passes: DataFrame) -> DataFrame:
    """Per run and subject: overlap of the last two completed passes, novelty of the last, convergence.

    Without findings in either pass the overlap is 1; with one pass it is null. The
    scopes of a subject's passes are the subject itself, so they always match.
    """
    rows = passes.where("completed").withColumn("f", F.array_distinct(_prints()))
    runs = rows.groupBy("run_id", "subject_id").agg(F.sort_array(F.collect_list(F.struct("pass_number", "f"))).alias("p"))
    last, prev = F.element_at("p", -1)["f"], F.get(F.col("p"), F.size("p") - 2)["f"]
    earlier = F.flatten(F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: x["f"]))
    union = F.size(F.array_union(last, prev))
    latest_new = F.size(F.array_except(last, earlier)).cast("long")
    both = F.size("p") >= 2
    jaccard = F.when(both, F.when(union > 0, F.bround(F.size(F.array_intersect(last, prev)) / union, 4)).otherwise(1.0))
    return runs.select("run_id", "subject_id", F.size("p").cast("long").alias("completed_passes"), latest_new.alias("new_findings_latest_pass"), jaccard.alias("jaccard"), (both & (latest_new == 0)).alias("converged"))


def cross_run_convergence(presence: DataFrame) -> DataFrame:
    """Compares the two newest fully completed runs of each subject."""
    two = presence.where("complete").withColumn("k", F.row_number().over(Window.partitionBy("subject_id").orderBy("rank"))).where("k <= 2")
    sig = two.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("verdicts", "fingerprints")).alias("a"), F.max(F.struct("verdicts", "fingerprints")).alias("b"))
    subjects = presence.select("subject_id").distinct()
    state = F.when(F.coalesce("n", F.lit(0)) < 2, "insufficient_runs").when(F.col("a") == F.col("b"), "stable").otherwise("changed")
    return subjects.join(sig, "subject_id", "left").select("subject_id", state.alias("convergence"))


def finding_history(passes: DataFrame) -> DataFrame:
    """Per subject and fingerprint: where it was seen, and its state in the newest run (``presence.found_states``)."""
    rows = _items(passes).select("run_id", "subject_id", "created_at", (F.col("total") == F.col("pass_total")).alias("complete"), _per_finding(F.col("items")).alias("findings"))
    return presence.found_states(rows.withColumn("rank", _newest_first())).drop("occurrences_by_run")


def pass_status(scope: DataFrame) -> DataFrame:
    """Per run and pass: state and subject counts."""
    n = F.count(F.lit(1))
    return scope.groupBy("run_id", "pass_number").agg(F.max("completed").alias("done"), n.alias("subject_count")).select(
        "run_id", "pass_number", F.when(F.col("done"), "complete").otherwise("pending").alias("state"), "subject_count", F.when(F.col("done"), F.col("subject_count")).otherwise(0).alias("completed_subject_count"), F.when(F.col("done"), 0).otherwise(F.col("subject_count")).cast("long").alias("pending_subject_count")
    )


def attempt_log(attempts: DataFrame) -> DataFrame:
    """Numbers the attempts of each pass in order of time and id."""
    return numbered(attempts, ["pass_id"], ["ts", "id"], "attempt_number")


def retry_summary(log: DataFrame) -> DataFrame:
    """Per pass: attempts, retries, counts of each status, and the latest status."""
    return log.groupBy("pass_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("attempt_number") > 1).alias("retries"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "timed_out", "invalid")],
        F.max_by("status", "attempt_number").alias("latest_status"),
        (~F.bool_or(F.col("status") == "succeeded")).alias("retryable"),
    )
