"""Ingest of audit results: validation, normal form, and the split into relations and attempts.

``responses``: pass_id and raw (the response's text). ``passes``: pass_id, contract,
input_sha256 and subjects, the ordered ids of the pass. A response with a fault becomes
an invalid attempt that names the first fault; a sound one gives verdicts and
occurrences. All checks but the identity of findings are column functions over
variants, so a value of a wrong type is a fault and not a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.jsonx import fingerprint_of, result_parts

#: The fields of a result, of its verdicts and of its findings, and their enumerations.
RESULT_FIELDS = ("completed_subject_ids", "contract_version", "findings", "input_sha256", "notes", "pass_id", "verdicts")
VERDICT_FIELDS = ("confidence", "rationale", "subject_id", "verdict")
FINDING_FIELDS = ("category", "detail", "evidence", "severity", "subject_id", "summary")
VERDICTS = ("clear", "finding", "uncertain")
SEVERITIES = ("low", "medium", "high", "critical")
LIMITS = {"subject_id": 80, "rationale": 4000, "category": 120, "summary": 2000, "detail": 8000, "note": 4000, "notes": 100}


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once for a row.

    The optimizer would write an expression out again wherever a later step or a pushed
    filter uses it; it does not look through a generator, here of one element.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", one.alias("__once")).select(*df.columns, "__once.*")


def _names(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _string(m: Column, key: str) -> Column:
    """The value of a key where it is a string."""
    x = F.try_element_at(m, F.lit(key))
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _number(m: Column, key: str) -> Column:
    x = F.try_element_at(m, F.lit(key))
    return F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(x, "$", "double"))


def _text_fault(value: Column, limit: str, empty: bool = False) -> Column:
    bad = value.isNull() | (F.length(value) > LIMITS[limit])
    return bad if empty else bad | ~value.rlike("(?U)\\S")


def _array(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def _verdict(m: Column) -> Column:
    return F.struct(
        F.coalesce(F.array_sort(F.map_keys(m)) == _names(*VERDICT_FIELDS), F.lit(False)).alias("fields"),
        _string(m, "subject_id").alias("subject"), _string(m, "verdict").alias("verdict"), _number(m, "confidence").alias("confidence"), _string(m, "rationale").alias("rationale"),
    )


def _finding(m: Column) -> Column:
    keys = F.array_sort(F.map_keys(m))
    evidence = F.try_element_at(m, F.lit("evidence"))
    return F.struct(
        F.coalesce((keys == _names(*FINDING_FIELDS)) | (keys == _names(*FINDING_FIELDS, "identity")), F.lit(False)).alias("fields"),
        *[_string(m, k).alias(a) for k, a in (("subject_id", "subject"), ("category", "category"), ("severity", "severity"), ("summary", "summary"), ("detail", "detail"))],
        (_map(evidence).isNotNull() | F.try_variant_get(evidence, "$", "array<variant>").isNotNull()).alias("evidence"),
    )


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def read_responses(responses: DataFrame, passes: DataFrame, complete: bool = True) -> DataFrame:
    """Each response with its parts, the identities and fingerprints of its findings, and ``error``, the first fault or null.

    Where ``passes`` have a column ``legacy``, its true rows have the older fingerprints,
    which hold the category as well.
    """
    # variants accept text after the value, which JSON does not
    rows = _once(responses.join(passes, "pass_id").withColumn("said", result_parts(F.col("raw"))).select("*", "said.*").drop("said"), {"v": F.try_parse_json("raw")})
    v, m = F.col("v"), F.col("m")
    rows = _once(rows, {"m": _map(v)})
    # the map of an item is made once; the schema of a long value costs far more than a look at its kind
    rows = _once(rows, {
        "keys": F.array_sort(F.map_keys(m)),
        "said_contract": _string(m, "contract_version"), "said_pass": _string(m, "pass_id"), "said_input": _string(m, "input_sha256"),
        "completed": F.transform(_array(v, "completed_subject_ids"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))),
        "verdicts": F.transform(F.transform(_array(v, "verdicts"), _map), _verdict), "findings": F.transform(F.transform(_array(v, "findings"), _map), _finding),
        "notes": F.transform(_array(v, "notes"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))),
    }).drop("v", "m")
    c, vs, fs = F.col("completed"), F.col("verdicts"), F.col("findings")
    inside = lambda x: F.array_contains(F.col("subjects"), x["subject"])
    confidence = lambda x: x["confidence"].isNull() | (x["confidence"] < 0) | (x["confidence"] > 1)
    judged = F.transform(vs, lambda x: x["subject"])
    found = F.transform(fs, lambda x: x["subject"])
    with_finding, without = (F.transform(F.filter(vs, f), lambda x: x["subject"]) for f in (lambda x: x["verdict"] == "finding", lambda x: x["verdict"] != "finding"))
    checks = {
        "not_an_object": F.col("keys").isNull() | F.col("canonical").isNull(),
        "result_fields": F.col("keys") != _names(*RESULT_FIELDS),
        "contract_or_pass": ~F.col("said_contract").eqNullSafe(F.col("contract")) | ~F.col("said_pass").eqNullSafe(F.col("pass_id")),
        "input_hash": ~F.col("said_input").eqNullSafe(F.col("input_sha256")),
        "completed_type": c.isNull() | F.exists(c, lambda x: x.isNull()),
        "completed_scope": (F.size(F.array_distinct(c)) != F.size(c)) | (F.size(F.array_except(c, "subjects")) > 0),
        "completed_coverage": F.lit(complete) & (F.size(c) != F.size("subjects")),
        "verdicts_type": vs.isNull(),
        "verdict_fields": F.exists(vs, lambda x: ~x["fields"]),
        "verdict_subject": F.exists(vs, lambda x: F.coalesce(_text_fault(x["subject"], "subject_id") | ~inside(x), F.lit(True))),
        "verdict_value": F.exists(vs, lambda x: F.coalesce(~x["verdict"].isin(*VERDICTS), F.lit(True))),
        "verdict_confidence": F.exists(vs, confidence),
        "verdict_rationale": F.exists(vs, lambda x: _text_fault(x["rationale"], "rationale", True)),
        "verdict_coverage": (F.size(vs) != F.size(c)) | ~_same_set(judged, c),
        "findings_type": fs.isNull(),
        "finding_fields": F.exists(fs, lambda x: ~x["fields"]),
        "finding_subject": F.exists(fs, lambda x: F.coalesce(_text_fault(x["subject"], "subject_id") | ~inside(x), F.lit(True))),
        "finding_category": F.exists(fs, lambda x: _text_fault(x["category"], "category")),
        "finding_severity": F.exists(fs, lambda x: F.coalesce(~x["severity"].isin(*SEVERITIES), F.lit(True))),
        "finding_summary": F.exists(fs, lambda x: _text_fault(x["summary"], "summary")),
        "finding_detail": F.exists(fs, lambda x: _text_fault(x["detail"], "detail", True)),
        "finding_evidence": F.exists(fs, lambda x: ~x["evidence"]),
    }
    later = {
        "finding_uncompleted": F.size(F.array_except(found, c)) > 0,
        "verdict_without_finding": F.size(F.array_except(with_finding, found)) > 0,
        "finding_without_verdict": F.arrays_overlap(without, found),
        "notes": F.col("notes").isNull() | (F.size("notes") > LIMITS["notes"]) | F.exists("notes", lambda x: x.isNull() | (F.length(x) > LIMITS["note"])),
    }
    first = lambda found: F.coalesce(*[F.when(bad, code) for code, bad in found.items()])
    # the later checks read parts that the earlier ones have found sound
    legacy = F.col("legacy") if "legacy" in rows.columns else F.lit(False)
    one = lambda x: F.when(legacy, fingerprint_of(x["findings"]["subject"], x["identities"], x["findings"]["category"])).otherwise(fingerprint_of(x["findings"]["subject"], x["identities"]))
    rows = _once(rows, {"early": first(checks)})
    rows = _once(rows, {"fingerprints": F.when(F.col("early").isNull(), F.transform(F.arrays_zip("findings", "identities"), one))})
    prints = F.col("fingerprints")
    twice = {"finding_identity": F.exists(prints, lambda x: x.isNull()), "duplicate_fingerprint": F.size(F.array_distinct(prints)) < F.size(prints)}
    return _once(rows, {"error": F.coalesce("early", first(twice | later))})


def ingest(responses: DataFrame, passes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, occurrences, attempts) of the responses; rows of faulty responses stay out of the first two."""
    rows = read_responses(responses, passes)
    attempts = rows.select("pass_id", F.when(F.col("error").isNull(), "succeeded").otherwise("invalid").alias("status"), "error", F.sha2(F.coalesce("canonical", "raw"), 256).alias("response_sha256"))
    sound = rows.where("error is null")
    # positions are found before the explosion, so that the ids of the pass are not in each of its rows
    judged = F.transform("verdicts", lambda x: F.struct(*[x[c].alias(c) for c in ("subject", "verdict", "confidence", "rationale")], F.array_position(F.col("subjects"), x["subject"]).alias("position")))
    verdicts = sound.select("pass_id", F.explode(judged).alias("x")).select("pass_id", "x.*")
    found = sound.select("pass_id", F.explode(F.arrays_zip("findings", "identities", "fingerprints")).alias("x"))
    parts = [F.col(f"x.findings.{c}").alias(c) for c in ("subject", "category", "severity", "summary", "detail")]
    return verdicts, found.select("pass_id", *parts, F.col("x.identities").alias("identity"), F.col("x.fingerprints").alias("fingerprint")), attempts


def normal_result(rows: DataFrame) -> DataFrame:
    """Per sound response: completed ids and verdicts in the order of the pass, findings by that order and fingerprint."""
    at = lambda s: F.array_position(F.col("subjects"), s)
    verdicts = F.array_sort(F.transform("verdicts", lambda x: F.struct(at(x["subject"]).alias("at"), x["subject"].alias("subject"), x["verdict"].alias("verdict"))))
    done = F.filter("subjects", lambda s: F.array_contains("completed", s))
    found = F.array_sort(F.transform(F.arrays_zip("findings", "fingerprints"), lambda x: F.struct(at(x["findings"]["subject"]).alias("at"), x["fingerprints"].alias("f"))))
    return rows.where("error is null").select("pass_id", done.alias("completed"), F.transform(verdicts, lambda x: F.concat_ws("=", x["subject"], x["verdict"])).alias("verdicts"), F.transform(found, lambda x: x["f"]).alias("fingerprints"))
