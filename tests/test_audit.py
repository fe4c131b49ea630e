"""Small audit runs with known consensus, convergence and history."""

from tidemark.operators import audit

SCORE = {"low": 15, "medium": 35, "high": 65, "critical": 90}


def relation(spark, passes, findings):
    """passes: (run, created, pass, {subject: verdict or None}); findings: (run, pass, subject, fingerprint, severity)."""
    found = {}
    for i, (run, n, s, f, severity) in enumerate(findings):
        found.setdefault((run, n, s), []).append((f, SCORE[severity], i, "c"))
    rows = [(run, created, n, s, v is not None, v, found.get((run, n, s), [])) for run, created, n, subjects in passes for s, v in subjects.items()]
    return spark.createDataFrame(rows, "run_id string, created_at string, pass_number int, subject_id string, completed boolean, verdict string, found array<struct<fingerprint:string,score:int,occ_id:int,category:string>>")


def dealt(passes):
    """Verdicts and occurrences of a relation of passes."""
    return passes.where("completed"), passes.selectExpr("run_id", "pass_number", "subject_id", "inline(found)")


def test_mixed_scope_consensus(spark):
    rel = relation(
        spark,
        [("r", "1", 1, {"Q1": "clear", "Q2": "finding"}), ("r", "1", 2, {"Q1": "uncertain"}), ("r", "1", 3, {"Q1": "clear", "Q2": "finding"})],
        [("r", 1, "Q2", "A", "medium"), ("r", 3, "Q2", "A", "high"), ("r", 3, "Q2", "B", "low")],
    )
    c = {r.fingerprint: r for r in audit.run_consensus(rel).collect()}
    assert (c["A"].consensus_count, c["A"].eligible, c["A"].ratio, c["A"].max_severity) == (2, 2, 1.0, "high")
    assert (c["A"].risk_score, c["A"].risk_level) == (75, "high")
    assert (c["B"].consensus_count, c["B"].eligible, c["B"].ratio) == (1, 2, 0.5)
    s = {r.subject_id: r for r in audit.question_summary(rel).collect()}
    assert (s["Q1"].clear, s["Q1"].uncertain, s["Q1"].disagreement, s["Q1"].pass_total) == (2, 1, True, 3)
    assert (s["Q2"].finding, s["Q2"].disagreement, s["Q2"].completed_passes) == (2, False, 2)
    assert s["Q1"].risk_score == 15 + 5 and s["Q2"].risk_score == 65 + 10


def test_plain_consensus(spark):
    rel = relation(
        spark,
        [("r", "1", n, {"Q1": v}) for n, v in ((1, "finding"), (2, "finding"), (3, "clear"))],
        [("r", 1, "Q1", "A", "medium"), ("r", 2, "Q1", "A", "high")],
    )
    (c,) = audit.run_consensus(rel).collect()
    assert (c.consensus_count, c.ratio, c.max_severity) == (2, 0.6667, "high")
    (j,) = audit.pass_jaccard(rel).collect()
    assert (j.completed_passes, j.new_findings_latest_pass, j.converged, j.jaccard) == (3, 0, True, 0.0)
    n = [(r.pass_number, r.finding_count, r.new_finding_count) for r in audit.within_run_novelty(*dealt(rel)).orderBy("pass_number").collect()]
    assert n == [(1, 1, 1), (2, 1, 0), (3, 0, 0)]


def test_empty_sets_overlap_fully(spark):
    rel = relation(spark, [("r", "1", 1, {"Q": "clear"}), ("r", "1", 2, {"Q": "clear"}), ("s", "2", 1, {"Q": "clear"})], [])
    j = {r.run_id: r for r in audit.pass_jaccard(rel).collect()}
    assert j["r"].jaccard == 1.0 and j["r"].converged
    assert j["s"].jaccard is None and not j["s"].converged


def history(spark, *runs):
    """runs: oldest first, (present, complete)."""
    passes, found = [], []
    for i, (present, complete) in enumerate(runs):
        r = f"run{i}"
        passes.append((r, str(i), 1, {"Q": "finding" if present else "clear"}))
        if not complete:
            passes.append((r, str(i), 2, {"Q": None}))
        if present:
            found.append((r, 1, "Q", "A", "low"))
    rel = relation(spark, passes, found)
    return audit.finding_history(rel).first(), audit.cross_run_convergence(audit.run_presence(rel)).first().convergence


def test_history_states(spark):
    h, c = history(spark, (True, True), (False, True))
    assert h.latest_state == "not_reproduced_in_latest_run" and c == "changed"
    h, c = history(spark, (True, True), (True, True))
    assert h.latest_state == "present_in_latest_run" and c == "stable" and h.intervening_runs == ""
    h, _ = history(spark, (True, True), (False, True), (True, True))
    assert h.latest_state == "reappeared_in_latest_run" and h.intervening_runs == "run1" and h.seen_run_count == 2
    h, c = history(spark, (True, True), (True, True), (True, False))
    assert h.latest_state == "latest_run_incomplete" and c == "stable"
    assert (h.first_seen_run_id, h.latest_seen_run_id, h.seen_run_count, h.occurrence_count) == ("run0", "run2", 3, 3)
    _, c = history(spark, (True, True))
    assert c == "insufficient_runs"


def test_attempts(spark):
    rows = spark.createDataFrame([("p", 1, 1, "failed"), ("p", 2, 2, "timed_out"), ("q", 1, 3, "succeeded")], "pass_id string, ts int, id int, status string")
    r = {x.pass_id: x for x in audit.retry_summary(audit.attempt_log(rows)).collect()}
    assert (r["p"].attempts, r["p"].retries, r["p"].latest_status, r["p"].retryable) == (2, 1, "timed_out", True)
    assert not r["q"].retryable
