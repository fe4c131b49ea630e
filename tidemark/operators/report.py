"""Whole audit reports: consensus, convergence, summaries, history and status.

The input is one relation, ``audits``: a row for a run, pass and subject of its scope, with
exam_id, run_id, created_at, pass_number, subject_id, completed, verdict (null while the
pass is open) and found, an array of (fingerprint, score, occ_id, category, summary,
auditor). Every report is one plan over all runs and subjects, and what belongs to one
subject of a run is worked out in one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.audit import VERDICTS, risk_level, severity_name
from tidemark.operators.presence import found_states

RUN = ["exam_id", "run_id"]
STATUSES = ("failed", "invalid", "succeeded", "timed_out")


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("long"))


def entries(a: DataFrame) -> DataFrame:
    """One entry for each done pass with a verdict on the subject, with its findings in order."""
    prints = F.array_sort(F.transform("found", lambda x: x["fingerprint"]))
    return a.where("completed").select("run_id", "pass_number", "subject_id", "created_at", "verdict", prints.alias("fingerprints"))


def execution_counts(a: DataFrame) -> DataFrame:
    """Per run and subject: passes whose scope holds the subject, and those of them that are done."""
    return a.groupBy(*RUN, "subject_id").agg(F.count(F.lit(1)).alias("pass_total"), F.count_if("completed").alias("completed_passes"))


def _findings(items: Column) -> Column:
    """The findings of a list of occurrences: the worst severity, and summaries and auditors up to the last."""

    def one(fingerprint: Column) -> Column:
        own = F.array_sort(F.transform(F.filter(items, lambda x: x["fingerprint"] == fingerprint), lambda x: F.struct(x["occ_id"].alias("occ_id"), x["category"].alias("category"), x["summary"].alias("summary"), x["auditor"].alias("auditor"), x["score"].alias("score"))))
        summaries = F.transform(own, lambda x: x["summary"])
        return F.struct(
            fingerprint.alias("fingerprint"), F.size(own).cast("long").alias("n_occurrences"), F.array_max(F.transform(own, lambda x: x["score"])).alias("top"), F.element_at(own, 1)["category"].alias("category"),
            F.element_at(summaries, -1).alias("last_summary"), summaries.alias("summaries"), F.array_sort(F.array_distinct(F.transform(own, lambda x: x["auditor"]))).alias("auditors"),
        )

    return F.transform(F.array_sort(F.array_distinct(F.transform(items, lambda x: x["fingerprint"]))), one)


def by_subject(a: DataFrame) -> DataFrame:
    """Per run and subject: its passes and verdicts counted, ``findings``, and ``passes``, the fingerprints of each done pass in order."""
    done = F.struct("pass_number", F.transform("found", lambda x: x["fingerprint"]).alias("f"))
    rows = a.groupBy(*RUN, "created_at", "subject_id").agg(
        F.count(F.lit(1)).alias("pass_total"), F.count("verdict").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.flatten(F.collect_list("found")).alias("items"), F.sort_array(F.collect_list(F.when(F.col("completed"), done))).alias("passes"),
    )
    return rows.withColumn("findings", _findings(F.col("items"))).drop("items")


def consensus_findings(a: DataFrame) -> DataFrame:
    """Findings of each run with agreement among the done passes that judged their subject; a pass has a finding once."""
    rows = by_subject(a).select(*RUN, "subject_id", F.col("total").alias("eligible"), F.explode("findings").alias("f")).select(*RUN, "subject_id", "eligible", "f.*")
    score = F.least(F.lit(100), F.col("top") + (F.col("n_occurrences") - 1) * 10).cast("long")
    ratio = F.when(F.col("eligible") > 0, F.bround(F.col("n_occurrences") / F.col("eligible"), 4)).otherwise(0.0)
    return rows.withColumns({"consensus_count": F.col("n_occurrences"), "max_severity": severity_name(F.col("top")), "risk_score": score, "ratio": ratio, "risk_level": risk_level(score, False)}).drop("top")


def run_convergence(a: DataFrame, order: DataFrame) -> DataFrame:
    """Per run: novelty of the last done pass, its overlap with the one before, and whether their scopes agree.

    ``order`` (subject_id, number) gives scopes their order, which counts. A fingerprint
    belongs to one subject, so what is new is told subject by subject.
    """
    before = lambda i: F.flatten(F.transform(F.slice("passes", F.lit(1), i), lambda x: x["f"]))
    each = F.transform("passes", lambda x, i: F.struct(x["pass_number"].alias("pass_number"), x["f"].alias("f"), F.size(F.array_except(x["f"], before(i))).alias("n_new")))
    rows = by_subject(a).select(*RUN, "subject_id", F.explode(each).alias("p")).join(order, "subject_id")
    rows = rows.groupBy(*RUN, "p.pass_number").agg(F.array_sort(F.collect_list(F.struct("number", "subject_id"))).alias("scope"), F.flatten(F.collect_list("p.f")).alias("f"), F.sum("p.n_new").alias("n_new"))
    two = rows.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("pass_number", "scope", "f", "n_new")), False).alias("p"))
    two = two.select(*RUN, F.size("p").cast("long").alias("completed_passes"), F.get("p", F.lit(0)).alias("p1"), F.get("p", F.lit(1)).alias("p2"))
    both = F.col("completed_passes") >= 2
    union = F.size(F.array_union("p1.f", "p2.f"))
    jaccard = F.when(both, F.when(union > 0, F.bround(F.size(F.array_intersect("p1.f", "p2.f")) / union, 4)).otherwise(1.0))
    match = F.when(both, F.col("p1.scope") == F.col("p2.scope"))
    return two.select(*RUN, "completed_passes", F.col("p1.n_new").alias("new_findings_latest_pass"), jaccard.alias("jaccard"), match.alias("scope_match"), (both & F.coalesce(match, F.lit(False)) & (F.col("p1.n_new") == 0)).alias("converged"))


def run_report(a: DataFrame, order: DataFrame) -> DataFrame:
    """One row for each run with a done pass: findings, risk and convergence."""
    found = consensus_findings(a).groupBy("run_id").agg(F.count(F.lit(1)).alias("findings"), F.max("risk_score").alias("risk_score"))
    rows = run_convergence(a, order).join(found, "run_id", "left")
    rows = rows.withColumns({"findings": _zero("findings"), "risk_score": _zero("risk_score")})
    return rows.withColumn("risk_level", risk_level(F.col("risk_score")))


def _converged() -> Column:
    """Whether a subject's last done pass brought nothing new; its scope in a run is the subject itself."""
    earlier = F.flatten(F.transform(F.slice("passes", F.lit(1), F.greatest(F.size("passes") - 1, F.lit(0))), lambda x: x["f"]))
    return (F.size("passes") >= 2) & (F.size(F.array_except(F.try_element_at("passes", F.lit(-1))["f"], earlier)) == 0)


def subject_convergence(a: DataFrame) -> DataFrame:
    return by_subject(a).where("total > 0").select("run_id", "subject_id", _converged().alias("converged"))


def summaries(a: DataFrame) -> DataFrame:
    """Per run and subject with a verdict: totals, risk, execution, findings and convergence."""
    rows = by_subject(a).where("total > 0")
    best = lambda name: F.coalesce(F.array_max(F.transform("findings", lambda x: x[name])), F.lit(0))
    kinds = sum(((F.col(v) > 0).cast("int") for v in VERDICTS[1:]), (F.col(VERDICTS[0]) > 0).cast("int"))
    rows = rows.withColumns({"top": best("top"), "again": best("n_occurrences"), "disagreement": kinds > 1, "converged": _converged(), "n_findings": F.size("findings").cast("long")})
    risk = F.col("top") + F.when(F.col("again") > 1, F.least(F.lit(20), (F.col("again") - 1) * 10)).otherwise(0) + F.when(F.col("disagreement"), 15).otherwise(0) + F.least(F.lit(10), F.col("uncertain") * 5)
    rows = rows.withColumn("risk_score", F.least(F.lit(100), risk).cast("long"))
    verdict = F.when(F.col("finding") > 0, "finding").when(F.col("uncertain") > 0, "uncertain").otherwise("clear")
    named = F.transform("findings", lambda x: x.withField("max_severity", severity_name(x["top"])))
    return rows.withColumns({"verdict": verdict, "risk_level": risk_level(F.col("risk_score")), "completed_passes": F.col("total"), "findings": named}).drop("top", "again", "passes")


def latest_runs(a: DataFrame) -> DataFrame:
    """``subject_id, newest_any, newest_judged`` in one aggregate: (created_at, run_id) of the newest run, and of the newest with a verdict.

    Ties of created_at go to the greater run id.
    """
    run = F.struct("created_at", "run_id")
    return a.groupBy("subject_id").agg(F.max(run).alias("newest_any"), F.max(F.when(F.col("completed"), run)).alias("newest_judged"))


def newest_summaries(a: DataFrame) -> DataFrame:
    """The summary of each subject in its newest run that has a verdict on it."""
    newest = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("created_at"), F.desc("run_id")))
    return summaries(a).withColumn("__k", newest).where("__k = 1").drop("__k")


def all_questions(a: DataFrame) -> DataFrame:
    """Per exam, the newest summary of each question rolled up."""
    rows = newest_summaries(a)
    passes = a.where("completed").join(rows.select("run_id", "subject_id"), ["run_id", "subject_id"], "left_semi").groupBy("exam_id").agg(F.count_distinct("run_id", "pass_number").alias("entries"))
    out = rows.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("questions"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.sum("total").alias("total_pass_observations"), F.count_if("disagreement").alias("disagreement"),
        F.max("risk_score").alias("risk_score"), F.count_if("converged").alias("converged_questions"), F.sum("n_findings").alias("unresolved_findings"), F.array_join(F.array_sort(F.collect_set("run_id")), ",").alias("source_run_ids"),
    )
    out = out.join(passes, "exam_id").withColumn("risk_level", risk_level(F.col("risk_score")))
    return out.withColumn("not_converged_questions", F.col("questions") - F.col("converged_questions"))


def audit_status(a: DataFrame) -> DataFrame:
    """Per run: audited questions, risk histogram and convergence. A fingerprint belongs to one subject."""
    return summaries(a).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("audited_questions"), F.sum("total").alias("total_pass_observations"), F.count_if("disagreement").alias("questions_with_disagreement"),
        *[F.count_if(F.col("risk_level") == level).alias(f"risk_{level}") for level in ("none", "low", "medium", "high", "critical")],
        F.count_if("converged").alias("converged"), F.count_if(~F.col("converged")).alias("not_converged"), F.sum("n_findings").alias("unique_unresolved_findings"),
    )


def ranked_runs(a: DataFrame) -> DataFrame:
    """Per subject and run in scope: newest first, whether all passes are done, and the rank among such runs."""
    runs = a.groupBy("run_id", "created_at", "subject_id").agg(
        F.count(F.lit(1)).alias("pass_total"), F.count_if("completed").alias("done"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.size(F.collect_set("verdict")).alias("kinds"), F.array_sort(F.flatten(F.collect_list(F.transform("found", lambda x: x["fingerprint"])))).alias("prints"),
    )
    order = Window.partitionBy("subject_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    rows = runs.withColumns({"rank": F.row_number().over(order), "complete": F.col("done") == F.col("pass_total")})
    rows = rows.withColumn("latest_complete", F.first("complete").over(order))
    k = F.sum(F.col("complete").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("k", F.when(F.col("complete"), k))


def subject_history(a: DataFrame) -> DataFrame:
    """Per subject: runs, cumulative verdicts and the newest run; its findings are null while it is incomplete."""
    newest = F.col("rank") == 1
    n = F.size(F.array_distinct("prints")).cast("long")
    return ranked_runs(a).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("run_count"), F.sum("done").alias("audit_count"), *[F.sum(v).alias(v) for v in VERDICTS], F.count_if(F.col("kinds") > 1).alias("disagreement_run_count"),
        F.max(F.when(newest, F.col("run_id"))).alias("latest_run_id"), F.bool_or(newest & F.col("complete")).alias("latest_run_complete"),
        F.max(F.when(F.col("k") == 1, F.col("run_id"))).alias("latest_completed_run_id"), F.max(F.when(newest & F.col("complete"), n)).alias("latest_run_finding_count"),
    )


def finding_history(a: DataFrame) -> DataFrame:
    """Per subject and fingerprint: where it was seen, and its state in the newest run.

    See ``presence.found_states``.
    """
    each = F.transform(F.array_distinct("prints"), lambda p: F.struct(p.alias("fingerprint"), F.size(F.filter("prints", lambda x: x == p)).cast("long").alias("n")))
    return found_states(ranked_runs(a).select("subject_id", "run_id", "rank", "complete", each.alias("findings")))


def pass_status(a: DataFrame, checkpoints: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per run and pass: state, subjects done and pending, checkpoints, and attempts by status.

    ``checkpoints``: run_id, pass_number, sequence, completed (array of subjects);
    ``attempts``: run_id, pass_number, attempt_number, status.
    """
    keys = ["run_id", "pass_number"]
    passes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("subject_count"), F.bool_or("completed").alias("done"))
    saved = checkpoints.groupBy(*keys).agg(F.count(F.lit(1)).alias("checkpoint_count"), F.max_by(F.size(F.array_distinct("completed")), "sequence").cast("long").alias("at_checkpoint"))
    tried = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempt_count"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.max_by("status", "attempt_number").alias("latest_attempt_status"))
    rows = passes.join(saved, keys, "left").join(tried, keys, "left")
    rows = rows.withColumns({c: _zero(c) for c in ("checkpoint_count", "at_checkpoint", "attempt_count", *STATUSES)})
    completed = F.when(F.col("done"), F.col("subject_count")).otherwise(F.col("at_checkpoint"))
    state = F.when(F.col("done"), "complete").when(F.col("checkpoint_count") > 0, "checkpointed").otherwise("pending")
    return rows.select(
        *keys, state.alias("state"), "subject_count", completed.alias("completed_subject_count"), F.greatest(F.lit(0).cast("long"), F.col("subject_count") - completed).alias("pending_subject_count"),
        "checkpoint_count", "attempt_count", *STATUSES, "latest_attempt_status", (~F.col("done") & (F.col("attempt_count") > 0)).alias("retryable"),
    )


def run_status(passes: DataFrame) -> DataFrame:
    """Per run: the roll-up of its passes."""
    return passes.groupBy("run_id").agg(F.count(F.lit(1)).alias("pass_total"), F.count_if(F.col("state") == "complete").alias("completed_passes"), F.sum("attempt_count").alias("attempt_total"), *[F.sum(s).alias(s) for s in STATUSES], F.count_if("retryable").alias("retryable"))


def execution_summary(log: DataFrame, passes: DataFrame) -> DataFrame:
    """Per run: retries, incomplete passes and whether any attempt failed."""
    retries = log.groupBy("run_id").agg(F.count_if(F.col("attempt_number") > 1).alias("retry_count"))
    rows = run_status(passes).join(retries, "run_id", "left")
    return rows.select("run_id", "attempt_total", _zero("retry_count").alias("retry_count"), F.greatest(F.lit(0).cast("long"), F.col("pass_total") - F.col("completed_passes")).alias("incomplete_passes"), (F.col("failed") + F.col("timed_out") + F.col("invalid") > 0).alias("has_partial_failures"))
