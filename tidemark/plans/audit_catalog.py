"""Queries over whole audit reports, on the projection of ``plans.exam``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import report
from tidemark.plans import exam
from tidemark.plans.registry import query

LEVEL = "CASE WHEN {0} >= 90 THEN 'critical' WHEN {0} >= 70 THEN 'high' WHEN {0} >= 40 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'none' END"
SEVERITY = "CASE {0} WHEN 15 THEN 'low' WHEN 35 THEN 'medium' WHEN 65 THEN 'high' ELSE 'critical' END"


def _order(spark, d):
    return exam.questions(spark, d).select("subject_id", "number")


FINDINGS = exam.SQL + f""", ex AS (SELECT exam_id, run_id, subject_id, count(*) AS pass_total, count(*) FILTER (completed) AS completed_passes FROM sc GROUP BY ALL),
fi AS (SELECT exam_id, run_id, subject_id, fingerprint, count(DISTINCT pass_number) AS consensus_count, count(*) AS n, max(score) AS top, arg_min(category, occ_id) AS category, arg_max(summary, occ_id) AS last_summary,
  string_agg(summary, ',' ORDER BY occ_id) AS summaries, string_agg(DISTINCT auditor, ',' ORDER BY auditor) AS auditors FROM oc GROUP BY exam_id, run_id, subject_id, fingerprint),
cf AS (SELECT fi.*, completed_passes AS eligible, round_even(consensus_count / completed_passes, 4) AS ratio, least(100, top + (n - 1) * 10)::BIGINT AS risk_score FROM fi JOIN ex USING (exam_id, run_id, subject_id))
"""


@query(f"SELECT run_id, subject_id, fingerprint, category, consensus_count, eligible, ratio, {SEVERITY.format('top')} AS max_severity, risk_score, {LEVEL.format('risk_score')} AS risk_level, summaries, last_summary, auditors FROM cf", FINDINGS)
def consensus_report_findings(spark, d):
    rows = report.consensus_findings(exam.audits(spark, d))
    return rows.select("run_id", "subject_id", "fingerprint", "category", "consensus_count", "eligible", "ratio", "max_severity", "risk_score", "risk_level", F.array_join("summaries", ",").alias("summaries"), "last_summary", F.array_join("auditors", ",").alias("auditors"))


CONVERGENCE = FINDINGS + """, ps AS (SELECT exam_id, run_id, pass_number, list(subject_id ORDER BY subject_id) AS scope FROM sc WHERE completed GROUP BY ALL),
pf AS (SELECT run_id, pass_number, list(DISTINCT fingerprint) AS f, count(DISTINCT fingerprint) FILTER (new) AS n_new FROM (SELECT *, min(pass_number) OVER (PARTITION BY run_id, fingerprint) = pass_number AS new FROM oc) GROUP BY ALL),
pk AS (SELECT exam_id, run_id, scope, coalesce(f, []) AS f, coalesce(n_new, 0) AS n_new, row_number() OVER (PARTITION BY run_id ORDER BY pass_number DESC) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM ps LEFT JOIN pf USING (run_id, pass_number)),
cv AS (SELECT x.exam_id, x.run_id, x.n AS completed_passes, x.n_new AS new_findings_latest_pass, x.scope = y.scope AS scope_match,
    CASE WHEN y.run_id IS NULL THEN NULL WHEN len(x.f) + len(y.f) = 0 THEN 1.0 ELSE round_even(len(list_intersect(x.f, y.f)) / len(list_distinct(x.f || y.f)), 4) END AS jaccard
  FROM (FROM pk WHERE k = 1) x LEFT JOIN (FROM pk WHERE k = 2) y USING (run_id))
"""


@query(f"""SELECT run_id, completed_passes, new_findings_latest_pass, jaccard, scope_match, completed_passes >= 2 AND coalesce(scope_match, false) AND new_findings_latest_pass = 0 AS converged, coalesce(findings, 0) AS findings, coalesce(risk, 0) AS risk_score, {LEVEL.format('coalesce(risk, 0)')} AS risk_level
FROM cv LEFT JOIN (SELECT run_id, count(*) AS findings, max(risk_score) AS risk FROM cf GROUP BY run_id) USING (run_id)""", CONVERGENCE)
def consensus_report_runs(spark, d):
    return report.run_report(exam.audits(spark, d), _order(spark, d)).drop("exam_id")


ENTRIES = """, en AS (SELECT vd.*, coalesce(f, []) AS f FROM vd LEFT JOIN (SELECT run_id, pass_number, subject_id, list(DISTINCT fingerprint ORDER BY fingerprint) AS f FROM oc GROUP BY run_id, pass_number, subject_id) USING (run_id, pass_number, subject_id))
"""


@query("SELECT run_id, pass_number, subject_id, verdict, array_to_string(f, ',') AS fingerprints FROM en", exam.SQL + ENTRIES)
def entries_per_question(spark, d):
    return report.entries(exam.audits(spark, d)).select("run_id", "pass_number", "subject_id", "verdict", F.array_join("fingerprints", ",").alias("fingerprints"))


@query("SELECT run_id, subject_id, pass_total, completed_passes FROM ex", FINDINGS)
def execution_counts(spark, d):
    return report.execution_counts(exam.audits(spark, d)).drop("exam_id")


SUMMARY = FINDINGS + ENTRIES + f""", cq AS (SELECT run_id, subject_id, n >= 2 AND len(list_filter(last, lambda x: NOT list_contains(coalesce(before, []), x))) = 0 AS converged FROM (
    SELECT run_id, subject_id, count(*) AS n, arg_max(f, pass_number) AS last, flatten(list(f) FILTER (NOT newest)) AS before FROM (SELECT *, pass_number = max(pass_number) OVER (PARTITION BY run_id, subject_id) AS newest FROM en) GROUP BY ALL)),
tt AS (SELECT run_id, subject_id, count(*) AS total, count(*) FILTER (verdict = 'clear') AS clear, count(*) FILTER (verdict = 'finding') AS finding, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(DISTINCT verdict) > 1 AS disagreement FROM vd GROUP BY ALL),
ff AS (SELECT run_id, subject_id, max(top) AS top, max(n) AS rec, count(*) AS n_findings, string_agg(fingerprint || ':' || n || ':' || {SEVERITY.format('top')} || ':' || last_summary || ':' || auditors, ';' ORDER BY fingerprint) AS findings FROM fi GROUP BY run_id, subject_id),
sm AS (SELECT ex.exam_id, tt.*, pass_total, coalesce(n_findings, 0) AS n_findings, coalesce(findings, '') AS findings, converged,
    least(100, coalesce(top, 0) + CASE WHEN rec > 1 THEN least(20, (rec - 1) * 10) ELSE 0 END + CASE WHEN disagreement THEN 15 ELSE 0 END + least(10, uncertain * 5))::BIGINT AS risk_score,
    CASE WHEN finding > 0 THEN 'finding' WHEN uncertain > 0 THEN 'uncertain' ELSE 'clear' END AS verdict
  FROM tt JOIN ex USING (run_id, subject_id) JOIN cq USING (run_id, subject_id) LEFT JOIN ff USING (run_id, subject_id)),
lr AS (SELECT subject_id, max(created_at || ' ' || run_id) AS m FROM vd GROUP BY subject_id),
ns AS (SELECT sm.* FROM sm JOIN lr ON lr.subject_id = sm.subject_id AND split_part(m, ' ', 2) = sm.run_id)
"""
SUMMARY_COLUMNS = ("run_id", "subject_id", "verdict", "total", "clear", "finding", "uncertain", "disagreement", "risk_score", "risk_level", "converged", "n_findings", "pass_total")


def _findings_text(rows):
    said = F.transform("findings", lambda x: F.concat_ws(":", x["fingerprint"], x["n_occurrences"], x["max_severity"], x["last_summary"], F.array_join(x["auditors"], ",")))
    return F.coalesce(F.array_join(said, ";"), F.lit("")).alias("findings")


@query(f"SELECT run_id, subject_id, verdict, total, clear, finding, uncertain, disagreement, risk_score, {LEVEL.format('risk_score')} AS risk_level, converged, n_findings, pass_total, findings FROM sm", SUMMARY)
def summarize_question(spark, d):
    rows = report.summaries(exam.audits(spark, d))
    return rows.select(*SUMMARY_COLUMNS, _findings_text(rows))


@query(f"""SELECT exam_id, count(*) AS questions, count(*) FILTER (verdict = 'clear') AS clear, count(*) FILTER (verdict = 'finding') AS finding, count(*) FILTER (verdict = 'uncertain') AS uncertain, sum(total)::BIGINT AS total_pass_observations, any_value(e) AS entries,
  count(*) FILTER (disagreement) AS disagreement, max(risk_score) AS risk_score, {LEVEL.format('max(risk_score)')} AS risk_level, count(*) FILTER (converged) AS converged_questions, count(*) FILTER (NOT converged) AS not_converged_questions, sum(n_findings)::BIGINT AS unresolved_findings, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS source_run_ids
FROM ns JOIN (SELECT vd.exam_id, count(DISTINCT vd.run_id || '/' || vd.pass_number) AS e FROM vd JOIN ns USING (run_id, subject_id) GROUP BY vd.exam_id) USING (exam_id) GROUP BY exam_id""", SUMMARY)
def summarize_all_questions(spark, d):
    return report.all_questions(exam.audits(spark, d))


@query(f"""SELECT run_id, count(*) AS audited_questions, sum(total)::BIGINT AS total_pass_observations, count(*) FILTER (disagreement) AS questions_with_disagreement, {', '.join(f"count(*) FILTER (level = '{x}') AS risk_{x}" for x in ('none', 'low', 'medium', 'high', 'critical'))},
  count(*) FILTER (converged) AS converged, count(*) FILTER (NOT converged) AS not_converged, sum(n_findings)::BIGINT AS unique_unresolved_findings FROM (SELECT *, {LEVEL.format('risk_score')} AS level FROM sm) GROUP BY run_id""", SUMMARY)
def audit_status(spark, d):
    return report.audit_status(exam.audits(spark, d))


@query("SELECT low, medium, high, runs FROM (SELECT count(*) FILTER (risk_score > 0 AND risk_score < 40) AS low, count(*) FILTER (risk_score >= 40 AND risk_score < 70) AS medium, count(*) FILTER (risk_score >= 70 AND risk_score < 90) AS high, count(DISTINCT run_id) AS runs FROM sm)", SUMMARY)
def audit_status_three_keys(spark, d):
    """The narrow histogram, without none and critical."""
    s = report.audit_status(exam.audits(spark, d))
    return s.agg(*[F.sum(f"risk_{x}").alias(x) for x in ("low", "medium", "high")], F.count(F.lit(1)).alias("runs"))


RANKED = exam.SQL + """, rr AS (SELECT run_id, created_at, subject_id, count(*) AS pass_total, count(*) FILTER (completed) AS done FROM sc GROUP BY ALL),
rk AS (SELECT *, done = pass_total AS complete, row_number() OVER (PARTITION BY subject_id ORDER BY created_at DESC, run_id DESC) AS rank FROM rr),
ck AS (SELECT subject_id, run_id, row_number() OVER (PARTITION BY subject_id ORDER BY rank) AS k FROM rk WHERE complete),
tv AS (SELECT run_id, subject_id, count(*) FILTER (verdict = 'clear') AS clear, count(*) FILTER (verdict = 'finding') AS finding, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(DISTINCT verdict) AS kinds FROM vd GROUP BY ALL),
nf AS (SELECT run_id, subject_id, count(DISTINCT fingerprint) AS n FROM oc GROUP BY run_id, subject_id)
"""


@query("""SELECT subject_id, count(*) AS run_count, sum(done)::BIGINT AS audit_count, coalesce(sum(clear), 0)::BIGINT AS clear, coalesce(sum(finding), 0)::BIGINT AS finding, coalesce(sum(uncertain), 0)::BIGINT AS uncertain, count(*) FILTER (kinds > 1) AS disagreement_run_count,
  arg_min(run_id, rank) AS latest_run_id, arg_min(complete, rank) AS latest_run_complete, arg_min(run_id, rank) FILTER (complete) AS latest_completed_run_id, CASE WHEN arg_min(complete, rank) THEN coalesce(max(n) FILTER (rank = 1), 0) END AS latest_run_finding_count
FROM rk LEFT JOIN tv USING (run_id, subject_id) LEFT JOIN nf USING (run_id, subject_id) GROUP BY subject_id""", RANKED)
def question_history(spark, d):
    return report.subject_history(exam.audits(spark, d))


@query("""SELECT o.subject_id, fingerprint, count(DISTINCT o.run_id) AS seen_run_count, any_value(total)::BIGINT AS occurrence_count, arg_max(o.run_id, rank) AS first_seen_run_id, arg_min(o.run_id, rank) AS latest_seen_run_id, string_agg(o.run_id || ':' || n, ',' ORDER BY rank) AS occurrences_by_run,
  CASE WHEN NOT any_value(lc) THEN 'latest_run_incomplete' WHEN bool_or(coalesce(k = 1, false)) AND coalesce(min(k) FILTER (k > 1) > 2, false) THEN 'reappeared_in_latest_run' WHEN bool_or(coalesce(k = 1, false)) THEN 'present_in_latest_run' ELSE 'not_reproduced_in_latest_run' END AS latest_state,
  CASE WHEN any_value(lc) AND bool_or(coalesce(k = 1, false)) AND coalesce(min(k) FILTER (k > 1) > 2, false) THEN array_to_string(any_value(ks)[2 : min(k) FILTER (k > 1) - 1], ',') ELSE '' END AS intervening_runs
FROM (SELECT subject_id, fingerprint, run_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY subject_id, fingerprint) AS total FROM oc GROUP BY subject_id, fingerprint, run_id) o
JOIN rk USING (subject_id, run_id) LEFT JOIN ck USING (subject_id, run_id) JOIN (SELECT subject_id, complete AS lc FROM rk WHERE rank = 1) USING (subject_id) LEFT JOIN (SELECT subject_id, list(run_id ORDER BY k) AS ks FROM ck GROUP BY subject_id) USING (subject_id)
GROUP BY o.subject_id, fingerprint""", RANKED)
def question_history_findings(spark, d):
    return report.finding_history(exam.audits(spark, d))


@query("SELECT subject_id, max(created_at || ' ' || run_id) AS newest_any, max(CASE WHEN completed THEN created_at || ' ' || run_id END) AS newest_judged FROM sc GROUP BY subject_id", exam.SQL)
def latest_run_any(spark, d):
    """The newest run with the subject in scope, and the newest with a verdict on it."""
    said = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(" ", f"{c}.created_at", f"{c}.run_id")).alias(c)
    return report.latest_runs(exam.audits(spark, d)).select("subject_id", said("newest_any"), said("newest_judged"))


# --- status ------------------------------------------------------------------------------


def checkpoints(a):
    """Two checkpoints for every open pass of even number, the first twenty and forty questions."""
    rows = a.where("not completed and pass_number % 2 = 0").select("exam_id", "run_id", "pass_number", "subject_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("sequence"))
    done = F.when(F.expr(f"subject_id % {exam.SIZE} + 1 <= 20 * sequence"), F.col("subject_id"))
    return rows.groupBy("exam_id", "run_id", "pass_number", "sequence").agg(F.array_sort(F.collect_list(done)).alias("completed"))


def attempts(a):
    passes = a.select("exam_id", "run_id", "pass_number", "completed").distinct().withColumn("n", F.expr("pass_number % 3")).where("n > 0")
    rows = passes.withColumn("attempt_number", F.explode(F.sequence(F.lit(1), F.col("n"))))
    status = F.when(F.col("completed") & (F.col("attempt_number") == F.col("n")), "succeeded").otherwise(F.element_at(F.array(F.lit("failed"), F.lit("timed_out"), F.lit("invalid")), F.expr("(pass_number + attempt_number) % 3 + 1")))
    return rows.select("exam_id", "run_id", "pass_number", "attempt_number", status.alias("status"))


STATUS = exam.SQL + f""", cp AS (SELECT exam_id, run_id, pass_number, s AS sequence, coalesce(list(subject_id ORDER BY subject_id) FILTER (subject_id % {exam.SIZE} + 1 <= 20 * s), []) AS completed FROM sc, range(1, 3) AS r(s) WHERE NOT completed AND pass_number % 2 = 0 GROUP BY ALL),
att AS (SELECT exam_id, run_id, pass_number, i AS attempt_number, CASE WHEN completed AND i = pass_number % 3 THEN 'succeeded' ELSE ['failed', 'timed_out', 'invalid'][(pass_number + i) % 3 + 1] END AS status FROM (SELECT DISTINCT exam_id, run_id, pass_number, completed FROM sc), range(1, 3) AS r(i) WHERE i <= pass_number % 3),
st AS (SELECT run_id, pass_number, any_value(s) AS subject_count, any_value(done) AS done, count(sequence) AS checkpoint_count, coalesce(len(arg_max(completed, sequence)), 0) AS at_checkpoint FROM (SELECT run_id, pass_number, count(*) AS s, bool_or(completed) AS done FROM sc GROUP BY ALL) LEFT JOIN cp USING (run_id, pass_number) GROUP BY ALL),
ta AS (SELECT run_id, pass_number, count(*) AS attempt_count, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in report.STATUSES)}, arg_max(status, attempt_number) AS latest_attempt_status FROM att GROUP BY ALL),
pr AS (SELECT run_id, pass_number, CASE WHEN done THEN 'complete' WHEN checkpoint_count > 0 THEN 'checkpointed' ELSE 'pending' END AS state, subject_count, CASE WHEN done THEN subject_count ELSE at_checkpoint END AS completed_subject_count, greatest(0, subject_count - CASE WHEN done THEN subject_count ELSE at_checkpoint END) AS pending_subject_count,
  checkpoint_count, coalesce(attempt_count, 0) AS attempt_count, {', '.join(f"coalesce({s}, 0) AS {s}" for s in report.STATUSES)}, latest_attempt_status, NOT done AND coalesce(attempt_count, 0) > 0 AS retryable FROM st LEFT JOIN ta USING (run_id, pass_number))
"""


def _passes(spark, d):
    a = exam.audits(spark, d)
    return report.pass_status(a, checkpoints(a), attempts(a))


@query("FROM pr", STATUS)
def status_report_passes(spark, d):
    return _passes(spark, d)


@query(f"SELECT run_id, count(*) AS pass_total, count(*) FILTER (state = 'complete') AS completed_passes, sum(attempt_count)::BIGINT AS attempt_total, {', '.join(f'sum({s})::BIGINT AS {s}' for s in report.STATUSES)}, count(*) FILTER (retryable) AS retryable FROM pr GROUP BY run_id", STATUS)
def status_report_runs(spark, d):
    return report.run_status(_passes(spark, d))


@query("SELECT run_id, attempt_total, coalesce(r, 0) AS retry_count, incomplete_passes, has_partial_failures FROM (SELECT run_id, sum(attempt_count)::BIGINT AS attempt_total, count(*) FILTER (state <> 'complete') AS incomplete_passes, sum(failed + timed_out + invalid) > 0 AS has_partial_failures FROM pr GROUP BY run_id) LEFT JOIN (SELECT run_id, count(*) FILTER (attempt_number > 1) AS r FROM att GROUP BY run_id) USING (run_id)", STATUS)
def execution_normalised(spark, d):
    a = exam.audits(spark, d)
    log = attempts(a)
    return report.execution_summary(log, report.pass_status(a, checkpoints(a), log))


@query("SELECT run_id, pass_number, subject_count, checkpoint_count, (SELECT count(*) FROM att WHERE att.run_id = pr.run_id AND att.pass_number = pr.pass_number) AS attempts FROM pr WHERE state <> 'complete'", STATUS)
def open_passes_with_checkpoint_count(spark, d):
    p = _passes(spark, d).where("state <> 'complete'")
    return p.select("run_id", "pass_number", "subject_count", "checkpoint_count", F.col("attempt_count").alias("attempts"))


@query("SELECT run_id, pass_number, sequence::BIGINT AS sequence, array_to_string(completed, ',') AS completed FROM cp QUALIFY row_number() OVER (PARTITION BY run_id, pass_number ORDER BY sequence DESC) = 1", STATUS)
def latest_checkpoint(spark, d):
    c = checkpoints(exam.audits(spark, d)).groupBy("run_id", "pass_number").agg(F.max("sequence").alias("sequence"), F.max_by("completed", "sequence").alias("completed"))
    return c.select("run_id", "pass_number", F.col("sequence").cast("long").alias("sequence"), F.array_join(F.transform("completed", lambda x: x.cast("string")), ",").alias("completed"))


@query("SELECT exam_id, run_id, string_agg(pass_number || '.' || attempt_number || '=' || status, ',' ORDER BY pass_number, attempt_number) AS log, count(*) AS n FROM att GROUP BY ALL", STATUS)
def attempts_of_run(spark, d):
    """The attempts of a run in order of pass and number."""
    rows = attempts(exam.audits(spark, d)).groupBy("exam_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("pass_number", "attempt_number", "status"))).alias("l"))
    said = F.transform("l", lambda x: F.concat(x["pass_number"].cast("string"), F.lit("."), x["attempt_number"].cast("string"), F.lit("="), x["status"]))
    return rows.select("exam_id", "run_id", F.array_join(said, ",").alias("log"), F.size("l").cast("long").alias("n"))
