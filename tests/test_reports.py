"""Golden cases of consensus, convergence, history and status, and of saves."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bundle, extract, report, review

SCORE = {"low": 15, "medium": 35, "high": 65, "critical": 90}
FOUND = "fingerprint string, score int, occ_id long, category string, summary string, auditor string"
AUDITS = f"exam_id long, run_id string, created_at string, pass_number int, subject_id long, completed boolean, verdict string, found array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>"


@pytest.fixture
def audits(spark):
    def make(runs):
        """runs: [(run, created, [{subject: verdict, or None while open, or (verdict, {fingerprint: severity})}])]."""
        rows, i = [], 0
        for run, created, passes in runs:
            for n, subjects in enumerate(passes, 1):
                for s, v in subjects.items():
                    verdict, fps = v if isinstance(v, tuple) else (v, {})
                    found = []
                    for fp, severity in fps.items():
                        found.append((fp, SCORE[severity], i, f"c{i}", f"s{i}", f"auditor-{n}"))
                        i += 1
                    rows.append((1, run, created, n, s, verdict is not None, verdict, found))
        return spark.createDataFrame(rows, AUDITS)

    return make


def test_consensus_takes_the_last_summary_and_the_worst_severity(audits):
    a = audits([("r", "1", [{1: "clear", 2: ("finding", {"A": "high"})}, {1: "uncertain"}, {1: "clear", 2: ("finding", {"A": "medium", "B": "low"})}])])
    c = {r.fingerprint: r for r in report.consensus_findings(a).collect()}
    assert (c["A"].consensus_count, c["A"].eligible, c["A"].ratio, c["A"].max_severity, c["A"].risk_score, c["A"].category, c["A"].last_summary) == (2, 2, 1.0, "high", 75, "c0", "s1")
    assert (c["B"].consensus_count, c["B"].ratio) == (1, 0.5) and c["A"].auditors == ["auditor-1", "auditor-3"]
    s = {r.subject_id: r for r in report.summaries(a).collect()}
    assert (s[1].clear, s[1].uncertain, s[1].disagreement, s[1].risk_score) == (2, 1, True, 20) and (s[2].pass_total, s[2].risk_score) == (2, 75)


def test_scope_mismatch_does_not_converge(spark, audits):
    a = audits([("r", "1", [{1: "clear", 2: "clear"}, {1: "clear"}])])
    order = spark.createDataFrame([(1, 1), (2, 2)], "subject_id long, number int")
    (run,) = report.run_report(a, order).collect()
    assert (run.scope_match, run.converged, run.jaccard, run.findings, run.risk_level) == (False, False, 1.0, 0, "none")
    assert {r.subject_id: r.converged for r in report.subject_convergence(a).collect()} == {1: True, 2: False}


def test_scopes_are_compared_in_order(spark, audits):
    a = audits([("r", "1", [{1: "clear", 2: "clear"}, {2: "clear", 1: "clear"}])])
    order = spark.createDataFrame([(1, 2), (2, 1)], "subject_id long, number int")
    (run,) = report.run_report(a, order).collect()
    assert run.scope_match and run.converged


def test_history_of_a_subject(audits):
    a = audits([("a", "1", [{1: "clear", 2: ("finding", {"F": "low"})}, {2: "clear"}]), ("b", "2", [{2: "clear"}]), ("c", "3", [{1: "clear"}])])
    h = {r.subject_id: r for r in report.subject_history(a).collect()}
    assert (h[2].run_count, h[2].audit_count, h[2].clear, h[2].finding, h[2].disagreement_run_count, h[2].latest_run_finding_count) == (2, 3, 2, 1, 1, 0)
    (f,) = report.finding_history(a).collect()
    assert f.latest_state == "not_reproduced_in_latest_run"


def test_incomplete_newest_run(audits):
    a = audits([("a", "1", [{2: ("finding", {"F": "low"})}]), ("b", "2", [{2: ("finding", {"F": "low"})}, {2: ("finding", {"F": "high"})}]), ("c", "3", [{2: "clear"}, {2: None}])])
    (f,) = report.finding_history(a).collect()
    assert (f.latest_state, f.first_seen_run_id, f.latest_seen_run_id, f.seen_run_count, f.occurrence_count) == ("latest_run_incomplete", "a", "b", 2, 3)
    (h,) = report.subject_history(a).collect()
    assert h.latest_run_finding_count is None and not h.latest_run_complete and h.latest_completed_run_id == "b"


def test_reappearance(audits):
    a = audits([("a", "1", [{2: ("finding", {"F": "low"})}]), ("b", "2", [{2: "clear"}]), ("c", "3", [{2: ("finding", {"F": "low"})}])])
    (f,) = report.finding_history(a).collect()
    assert (f.latest_state, f.intervening_runs, f.seen_run_count, f.occurrence_count) == ("reappeared_in_latest_run", "b", 2, 2)


def test_pass_status(spark, audits):
    a = audits([("r", "1", [{1: "clear", 2: "clear"}, {1: None, 2: None}, {1: None}])])
    saved = spark.createDataFrame([("r", 2, 1, [1]), ("r", 2, 2, [1, 2])], "run_id string, pass_number int, sequence int, completed array<long>")
    tried = spark.createDataFrame([("r", 2, 1, "timed_out"), ("r", 2, 2, "failed")], "run_id string, pass_number int, attempt_number int, status string")
    p = {r.pass_number: r for r in report.pass_status(a, saved, tried).collect()}
    assert [p[n].state for n in (1, 2, 3)] == ["complete", "checkpointed", "pending"]
    assert (p[2].completed_subject_count, p[2].pending_subject_count, p[2].latest_attempt_status, p[2].retryable, p[3].retryable) == (2, 0, "failed", True, False)


def test_resumed_results(spark):
    r = spark.createDataFrame([("r", n, 2, [1, 2], [3, 4]) for n in range(5)], "run_id string, pass_number int, sequence int, completed array<long>, remaining array<long>")
    answers = [(0, 2, [4, 3]), (1, 1, [3, 4]), (2, 2, [3]), (3, 2, [2, 3, 4]), (9, 2, [3, 4])]
    got = bundle.merge_resumed(r, spark.createDataFrame([("r", *x) for x in answers], "run_id string, pass_number int, resume_sequence int, completed_now array<long>"))
    assert {x.pass_number: (x.status, x.merged) for x in got.collect()} == {0: ("merged", [1, 2, 3, 4]), 1: ("stale", None), 2: ("not_the_remaining", None), 3: ("overlap", None), 9: ("no_checkpoint", None)}


def test_saved_pair_is_mirrored(spark):
    q = spark.createDataFrame([(1, 1, 25, "listening"), (2, 1, 26, "listening"), (3, 1, 40, "reading")], "subject_id long, exam_id long, number int, section string")
    assets = spark.createDataFrame([(1, 600.0, "sha")], "exam_id long, duration_seconds double, source_sha256 string")
    stored = spark.createDataFrame([(1, 1, 25, 0, 900, "candidate", 3, "clip"), (2, 1, 26, 0, 900, "candidate", 3, "clip")], "subject_id long, exam_id long, number int, start_ms int, end_ms int, segment_status string, version int, clip string")

    def save(subject, version, start, end, status="verified", sha="sha", rows=stored):
        p = spark.createDataFrame([(subject, version, start, end, status, sha)], "subject_id long, version int, start_ms int, end_ms int, segment_status string, source_sha256 string")
        return sorted((r.subject_id, r.outcome, r.fault, r.start_ms, r.version, r.clip) for r in review.save_segments(q, assets, rows, p).collect())

    assert save(2, 3, 100, 900) == [(1, "saved", None, 100, 4, None), (2, "saved", None, 100, 4, None)]
    assert save(2, 3, 0, 900, "candidate") == [(1, "unchanged", None, 0, 3, "clip"), (2, "unchanged", None, 0, 3, "clip")]
    assert {x[1] for x in save(2, 2, 100, 900)} == {"conflict"}
    assert {x[2] for x in save(2, 3, 100, 599)} == {"bounds"} and {x[2] for x in save(2, 3, 100, 600_001)} == {"beyond_source"} and {x[2] for x in save(2, 3, 1, 900, sha="x")} == {"source_changed"} and {x[2] for x in save(3, 0, 0, 900)} == {"section"}
    assert {x[1] for x in save(1, 0, 0, 900, rows=stored.where("false"))} == {"not_previewed"}


def test_answer_table_faults(spark):
    good = "답지 x 듣기 배점 y 배점 1 ① 3\n2 2 4 답지 9 9 9"
    texts = {"ok": good, "mark": good.replace("듣기", ""), "marks": good.replace("답지", ""), "cells": good.replace("2 2 4", "2 2"), "row": good.replace("①", "5"), "points": good.replace(" 4 ", " 5 "), "dup": good.replace("2 2 4", "1 2 4"), "gap": good.replace("2 2 4", "3 2 4"), "sum": good.replace(" 4 ", " 3 "), "none": None}
    pages = spark.createDataFrame([(k, "listening", 1, t) for k, t in texts.items()], "doc string, section string, page int, text string")
    rows, faults = extract.answer_tables(pages, {"listening": 2}, 7)
    assert sorted((r.doc, r.number, r.choice, r.points) for r in rows.collect()) == [("ok", 1, 1, 3), ("ok", 2, 2, 4)]
    assert {r.doc: r.fault for r in faults.collect()} == {"mark": "section_mark", "marks": "table_marks", "cells": "cells", "row": "row", "points": "row", "dup": "duplicate", "gap": "row", "sum": "total", "none": "section_mark"}


def test_correction_maps_and_gate(spark):
    t = spark.createDataFrame([(1, "stem", "가.나.다"), (1, "note", "3.14"), (2, "stem", "가, 나")], "id long, field string, text string")
    c = extract.corrections(t, "[가-힣]", "[가-힣]")
    (m,) = extract.change_maps(c).collect()
    assert (m.id, m.fields, m.spaces) == (1, 1, 2) and m.changes == '{"stem":{"after":"가. 나. 다","before":"가.나.다"}}'
    wanted = spark.createDataFrame([("stem", 2), ("note", 1)], "field string, spaces long")
    assert {r.field: r.ok for r in extract.extent_gate(c, wanted).collect()} == {"stem": True, "note": False}


def test_histories_keep_thirty(spark):
    records = spark.range(1, 41).select(F.col("id"), F.lit(1).cast("long").alias("subject_id"), F.lit("verified").alias("status"), F.lit("s").alias("scope"), F.when(F.expr("id = 40"), '{"note":"last"}').when(F.expr("id = 39"), "bad").otherwise("[]").alias("evidence"), F.lit("d").alias("reviewed_at"))
    (h,) = review.histories(records).collect()
    assert h.version == 40 and len(h.history) == 30 and [x.note for x in h.history[:3]] == ["last", "", ""]
