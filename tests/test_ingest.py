"""Faults of results one at a time, and what sound ones become."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonx
from tidemark.operators import ingest
from tidemark.plans import catalog

FINDING = {"subject_id": "Q2", "category": "c", "severity": "high", "summary": "s", "detail": "", "identity": {"field": " A  b", "n": 1.0}, "evidence": {"page": 1}}
GOOD = {
    "contract_version": "v", "pass_id": "p", "input_sha256": "h", "completed_subject_ids": ["Q2", "Q1"], "notes": [],
    "verdicts": [{"subject_id": "Q1", "verdict": "clear", "confidence": 1, "rationale": ""}, {"subject_id": "Q2", "verdict": "finding", "confidence": 0.5, "rationale": "r"}], "findings": [FINDING],
}


def changed(**parts):
    out = copy.deepcopy(GOOD)
    for path, value in parts.items():
        at, *steps = path.split("__")
        holder, key = out, at
        for step in steps:
            holder, key = holder[key], int(step) if step.isdigit() else step
        if value is KeyError:
            del holder[key]
        else:
            holder[key] = value
    return json.dumps(out)


CASES = [
    (json.dumps(GOOD), None),
    ("[]", "not_an_object"), ("{", "not_an_object"), (json.dumps(GOOD) + "}", "not_an_object"), (None, "not_an_object"),
    (changed(extra=1), "result_fields"), (changed(notes=KeyError), "result_fields"),
    (changed(contract_version="w"), "contract_or_pass"), (changed(pass_id=7), "contract_or_pass"), (changed(input_sha256="x"), "input_hash"),
    (changed(completed_subject_ids="Q1"), "completed_type"), (changed(completed_subject_ids=["Q1", 2]), "completed_type"), (changed(completed_subject_ids=["Q1", "Q1"]), "completed_scope"), (changed(completed_subject_ids=["Q1", "Q9"]), "completed_scope"), (changed(completed_subject_ids=["Q1"]), "completed_coverage"),
    (changed(verdicts={}), "verdicts_type"), (changed(verdicts__0__more=1), "verdict_fields"), (changed(verdicts__0="Q1"), "verdict_fields"), (changed(verdicts__0__subject_id="Q9"), "verdict_subject"), (changed(verdicts__0__verdict="ok"), "verdict_value"),
    (changed(verdicts__0__confidence=True), "verdict_confidence"), (changed(verdicts__0__confidence="1"), "verdict_confidence"), (changed(verdicts__0__confidence=1.5), "verdict_confidence"), (changed(verdicts__0__rationale="r" * 4001), "verdict_rationale"), (changed(verdicts__0=GOOD["verdicts"][1]), "verdict_coverage"),
    (changed(findings=None), "findings_type"), (changed(findings__0__x=1), "finding_fields"), (changed(findings__0__severity="fatal"), "finding_severity"), (changed(findings__0__category=" "), "finding_category"), (changed(findings__0__summary=""), "finding_summary"),
    (changed(findings__0__evidence="text"), "finding_evidence"), (changed(findings__0__identity={}), "finding_identity"), (changed(findings=[FINDING, dict(FINDING, category="d", identity={"field": "a B", "n": 1.0})]), "duplicate_fingerprint"),
    (changed(findings=[]), "verdict_without_finding"), (changed(verdicts__1__verdict="uncertain"), "finding_without_verdict"), (changed(notes=["n"] * 101), "notes"), (changed(notes=[1]), "notes"),
]


@pytest.fixture(scope="module")
def ingested(spark):
    raws = [raw for raw, _ in CASES]
    rows = [(f"p{i}", None if r is None else r.replace('"pass_id": "p"', f'"pass_id": "p{i}"')) for i, r in enumerate(raws)]
    passes = spark.createDataFrame([(f"p{i}", "v", "h", ["Q1", "Q2"]) for i in range(len(rows))], "pass_id string, contract string, input_sha256 string, subjects array<string>")
    return ingest.ingest(spark.createDataFrame(rows, "pass_id string, raw string"), passes)


def test_first_fault(ingested):
    got = {r.pass_id: r.error for r in ingested[2].collect()}
    assert [got[f"p{i}"] for i in range(len(CASES))] == [code for _, code in CASES]


def test_only_sound_results_become_rows(ingested):
    verdicts, found, _ = ingested
    assert sorted((r.pass_id, r.subject, r.verdict, r.confidence, r.position) for r in verdicts.collect()) == [("p0", "Q1", "clear", 1.0, 1), ("p0", "Q2", "finding", 0.5, 2)]
    (f,) = found.collect()
    assert f.identity == '{"field":"a b","n":1.0}' and (f.subject, f.severity) == ("Q2", "high")


def test_identity_falls_back_on_evidence():
    whole = {"field": "X", "observed": [1], "expected": None, "more": 2}
    assert jsonx.identity_of({"evidence": whole}) == '{"expected":null,"field":"x","observed":[1]}'
    assert jsonx.identity_of({"evidence": {"a": "Ｂ  c"}}) == '{"a":"b c"}'
    assert jsonx.identity_of({"evidence": []}) is None and jsonx.identity_of({"evidence": {}, "identity": "x"}) is None
    assert jsonx.identity_of({"evidence": {"a": "b" * 20_001}, "identity": {"k": 1}}) is None


def test_fingerprint_leaves_the_category_out(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Q", "a", '{"x":"y"}'), ("Q", "b", '{"x":"Y "}')], "s string, c string, i string")
    rows = df.select(jsonx.fingerprint(F.col("s"), F.col("i")).alias("new"), jsonx.fingerprint(F.col("s"), F.col("i"), F.col("c")).alias("old")).collect()
    assert rows[0].new == rows[1].new and rows[0].old != rows[1].old


@pytest.mark.parametrize("name", ["result_normal_form", "ingest_attempts", "ingest_verdicts", "ingest_occurrences"])
def test_texts_are_parsed_once_and_lines_joined_once(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and "l_orderkey" not in plan


def test_parts_of_a_result(spark):
    texts = ['{"findings":[{"evidence":{"b":1.0,"a":" X"}},7]}', '{"findings":3}', "[1e2]", "{}}", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").withColumn("x", jsonx.result_parts(F.col("raw"))).orderBy("i").collect()
    said = ['{"findings":[{"evidence":{"a":" X","b":1.0}},7]}', '{"findings":3}', "[100.0]", None, None]
    assert [r.x.canonical for r in rows] == said
    assert [r.x.identities for r in rows] == [['{"a":"x","b":1.0}', None], None, None, None, None]
