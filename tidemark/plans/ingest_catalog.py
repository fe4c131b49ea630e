"""Queries over documents of exams and passes, and over the ingest of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import jsonx
from tidemark.operators import bundle, ingest
from tidemark.plans import exam
from tidemark.plans.audit_catalog import STATUS, checkpoints
from tidemark.plans.registry import query, table
from tidemark.sinks import files as sinks
from tidemark.sinks import store
from tidemark.sources import files
from tidemark.sources.files import scratch
from tidemark.streaming import attempts


def documents(spark, d):
    q = exam.questions(spark, d)
    return bundle.question_documents(q, exam.choices(q), exam.answers(q), exam.groups(q), exam.transcripts(q), exam.images(q), exam.assets(q), exam.segments(q))


DOCS = exam.SQL + """, dc AS (SELECT q.exam_id, number, subject_id, section, to_json({answer: {choice_number: choice_number, source_page: answer_page}, audio_candidate: CASE WHEN seg.end_ms IS NOT NULL THEN {end_ms: seg.end_ms, source_sha256: source_sha256, start_ms: seg.start_ms} END, choices: cs,
    exam_number: number, "group": CASE WHEN gr.g IS NOT NULL THEN {first_number: first_number, instruction: instruction, last_number: last_number} END, id: subject_id, images: coalesce(ims, []), points: points, requires_image: requires_image, section: section, stem: stem,
    transcript: CASE WHEN dialogue IS NOT NULL THEN {text: dialogue, warnings: CASE WHEN warnings_json = '["shared"]' THEN ['shared'] ELSE [] END} END})::VARCHAR AS doc
  FROM q LEFT JOIN (SELECT subject_id, list({number: choice, text: text} ORDER BY choice) AS cs FROM ch GROUP BY subject_id) USING (subject_id) JOIN an USING (subject_id) LEFT JOIN gr ON gr.exam_id = q.exam_id AND gr.g = (number - 1) // 10
  LEFT JOIN tr USING (subject_id) LEFT JOIN (SELECT subject_id, list(image_key ORDER BY image_key) AS ims FROM im GROUP BY subject_id) USING (subject_id) LEFT JOIN (SELECT subject_id, start_ms, end_ms FROM seg) seg USING (subject_id) LEFT JOIN asst ON asst.exam_id = q.exam_id),
sn AS (SELECT exam_id, '{"exam":{"id":' || exam_id || '},"questions":[' || string_agg(doc, ',' ORDER BY number) || ']}' AS j, count(*) AS n_questions FROM dc GROUP BY exam_id)
"""


@query("SELECT exam_id, subject_id, doc FROM dc", DOCS)
def question_documents(spark, d):
    return documents(spark, d).select("exam_id", "subject_id", "doc")


@query("SELECT exam_id, n_questions, sha256(j) AS snapshot_sha256, length(j)::BIGINT AS size FROM sn", DOCS)
def source_snapshot(spark, d):
    s = bundle.snapshots(documents(spark, d))
    return s.select("exam_id", "n_questions", "snapshot_sha256", F.length("snapshot_json").cast("long").alias("size"))


@query("""SELECT exam_id, count(*) AS n, sha256(string_agg(sha256(body), chr(10) ORDER BY number)) AS sha256, count(*) FILTER (changed) AS added, sum(length(body))::BIGINT AS characters, 0::BIGINT AS faults
FROM (SELECT exam_id, number, subject_id % 50 = 0 AS changed, CASE WHEN subject_id % 50 = 0 THEN doc || ' ' ELSE doc END AS body FROM dc) GROUP BY exam_id""", DOCS)
def snapshot_store(spark, d):
    """A second snapshot, of which one document in fifty changed, adds those alone and is read back by hash."""
    docs = documents(spark, d).select("exam_id", "number", F.col("doc").alias("body"), "subject_id")
    s = store.DocumentStore(spark, scratch(spark, "store"))
    s.snapshot(docs, "first", "exam_id", "number")
    before = s.stored().select("hash")
    s.snapshot(docs.withColumn("body", F.when(F.col("subject_id") % 50 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body"))), "second", "exam_id", "number")
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("exam_id", "number"))
    rows = s.read("second", kind).join(before.withColumn("old", F.lit(1)), "hash", "left")
    got = rows.groupBy("exam_id").agg(F.count_if(F.col("old").isNull()).alias("added"), F.sum(F.length("body")).alias("characters"), F.count("fault").alias("faults"))
    return s.identities("second", kind, "exam_id", "number").join(got, "exam_id")


def _requests(spark, d):
    """Subjects with an urgent order, in the order of their newest one, and an unknown one for some exams."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.max("o_orderkey").alias("at")).withColumn("exam_id", F.expr(f"subject_id div {exam.SIZE}"))
    unknown = exam.questions(spark, d).select("exam_id").distinct().where("exam_id % 5 = 2").select(F.expr("-1 - exam_id").alias("subject_id"), F.lit(-1).cast("long").alias("at"), "exam_id")
    return urgent.unionByName(unknown)


REQUESTS = DOCS + f""", rq AS (SELECT o_custkey AS subject_id, max(o_orderkey) AS at_key, o_custkey // {exam.SIZE} AS exam_id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey UNION ALL SELECT DISTINCT -1 - exam_id, -1, exam_id FROM q WHERE exam_id % 5 = 2)
"""


@query("""SELECT exam_id, CASE WHEN u = 0 THEN 'created' ELSE 'unknown_subjects' END AS status, ids AS unknown_ids, CASE WHEN u = 0 THEN n END AS subject_count, CASE WHEN u = 0 THEN sha256('{"exam":{"id":' || exam_id || '},"questions":[' || js || ']}') END AS snapshot_sha256
FROM (SELECT rq.exam_id, count(*) FILTER (doc IS NULL) AS u, coalesce(string_agg(rq.subject_id::VARCHAR, ',' ORDER BY rq.subject_id) FILTER (doc IS NULL), '') AS ids, count(doc) AS n, string_agg(doc, ',' ORDER BY number) AS js FROM rq LEFT JOIN dc USING (subject_id) GROUP BY rq.exam_id)""", REQUESTS)
def run_scope_freeze(spark, d):
    return bundle.frozen_runs(documents(spark, d), _requests(spark, d))


@query("SELECT rq.exam_id, rq.subject_id, row_number() OVER (PARTITION BY rq.exam_id ORDER BY at_key) AS position, q.subject_id IS NOT NULL AS known FROM rq LEFT JOIN q USING (subject_id)", REQUESTS)
def scope_intersection(spark, d):
    """Requested subjects in the order of the request; unknown ones are told apart, not dropped."""
    rows = bundle.numbered(_requests(spark, d), "exam_id", "at", "position").select("exam_id", "subject_id", F.col("position").cast("long").alias("position"))
    return bundle.requested_scope(rows, exam.questions(spark, d))


def _passes(spark, d):
    exams = exam.questions(spark, d).select("exam_id").distinct()
    auditors = F.posexplode(F.array(*[F.lit(x) for x in ("ann", "bo", "cy")]))
    rows = exams.select("exam_id", F.concat(F.lit("run-e"), "exam_id").alias("run_id"), auditors.alias("i", "auditor_id"))
    return rows.select("exam_id", "run_id", (F.col("i") + 1).alias("pass_number"), "auditor_id", F.when(F.col("i") == 2, exam.ALIGNMENT).otherwise("independent").alias("perspective"))


def _bundles(spark, d):
    docs = documents(spark, d)
    return bundle.blind_bundles(docs, _passes(spark, d), bundle.snapshots(docs), exam.ALIGNMENT)


BUNDLES = DOCS + f""", bp AS (SELECT exam_id, 'run-e' || exam_id AS run_id, i::INT AS pass_number, ['ann', 'bo', 'cy'][i] AS auditor_id, CASE WHEN i = 3 THEN '{exam.ALIGNMENT}' ELSE 'independent' END AS perspective FROM (SELECT DISTINCT exam_id FROM q), range(1, 4) AS r(i)),
bs AS (SELECT bp.*, string_agg(doc, ',' ORDER BY number) AS js, string_agg(subject_id::VARCHAR, ',' ORDER BY number) AS subjects, count(*) AS n FROM bp JOIN dc USING (exam_id) WHERE perspective <> '{exam.ALIGNMENT}' OR section = 'listening' GROUP BY ALL),
bb AS (SELECT bs.*, sha256('{{"auditor_id":"' || auditor_id || '","blind":true,"contract_version":"{bundle.CONTRACT}","pass_number":' || pass_number || ',"perspective":"' || perspective || '","run_id":"' || run_id || '","snapshot_sha256":"' || sha256(j) || '","subjects":[' || js || ']}}') AS input_sha256 FROM bs JOIN sn USING (exam_id))
"""


@query("SELECT exam_id, pass_number, auditor_id, perspective, n AS n_subjects, subjects, input_sha256 FROM bb", BUNDLES)
def blind_pass_bundle(spark, d):
    b = _bundles(spark, d)
    return b.select("exam_id", "pass_number", "auditor_id", "perspective", F.size("subjects").cast("long").alias("n_subjects"), F.array_join(F.col("subjects").cast("array<string>"), ",").alias("subjects"), "input_sha256")


@query("SELECT exam_id, pass_number, exam_id % 4 <> 1 AS hash_holds, exam_id % 4 <> 2 AS field_holds FROM bb", BUNDLES)
def input_hash_binding(spark, d):
    """Stored inputs some of which were changed, and some of whose columns were."""
    b = _bundles(spark, d)
    b = b.withColumn("input_json", F.when(F.expr("exam_id % 4 = 1"), F.replace(F.col("input_json"), F.lit('"blind":true'), F.lit('"blind":false'))).when(F.expr("exam_id % 4 = 2"), F.regexp_replace("input_json", '"input_sha256":"[0-9a-f]{64}"', f'"input_sha256":"{"0" * 64}"')).otherwise(F.col("input_json")))
    return bundle.bound_inputs(b).select("exam_id", "pass_number", "hash_holds", "field_holds")


@query("SELECT run_id, subject_id::VARCHAR AS subject FROM (SELECT DISTINCT run_id, subject_id FROM sc WHERE subject_id % 9 <> 4)", exam.SQL)
def audit_subject_ids(spark, d):
    """The scope of all passes of a run, read from their stored inputs, where some ids are numbers."""
    a = exam.audits(spark, d)
    item = F.when(F.expr("subject_id % 9 = 4"), F.to_json(F.struct(F.col("subject_id").alias("id")))).otherwise(F.to_json(F.struct(F.col("subject_id").cast("string").alias("id"))))
    inputs = a.groupBy("run_id", "pass_number").agg(F.concat(F.lit('{"subjects":[7,'), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("input_json"))
    return bundle.string_ids(inputs, "run_id")


def _scopes(a):
    return a.where("not completed").groupBy("run_id", "pass_number").agg(F.array_sort(F.collect_list("subject_id")).alias("subjects"))


RESUME = STATUS + """, nc AS (SELECT run_id, pass_number, max(sequence) AS sequence, arg_max(completed, sequence) AS completed FROM cp GROUP BY ALL),
rs AS (SELECT run_id, pass_number, sequence, completed, list_sort(list_filter(subjects, lambda x: NOT list_contains(completed, x))) AS remaining FROM nc JOIN (SELECT run_id, pass_number, list(subject_id) AS subjects FROM sc WHERE NOT completed GROUP BY ALL) USING (run_id, pass_number))
"""


@query("SELECT run_id, pass_number, sequence::BIGINT AS sequence, array_to_string(completed, ',') AS completed, array_to_string(remaining, ',') AS remaining FROM rs", RESUME)
def resume_bundle(spark, d):
    a = exam.audits(spark, d)
    r = bundle.resume_bundles(_scopes(a), checkpoints(a))
    return r.select("run_id", "pass_number", F.col("sequence").cast("long").alias("sequence"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("completed", "remaining")])


@query("""SELECT run_id, pass_number, status, CASE WHEN status = 'merged' THEN array_to_string(completed || remaining, ',') END AS merged FROM (SELECT *, CASE WHEN m = 0 THEN 'stale' WHEN m = 1 AND len(completed) > 0 THEN 'overlap' WHEN m = 2 AND len(remaining) > 0 THEN 'not_the_remaining' ELSE 'merged' END AS status FROM (SELECT *, (length(run_id) + pass_number + len(remaining)) % 4 AS m FROM rs))""", RESUME)
def resume_merge(spark, d):
    """Answers to resumed passes: a quarter each stale, overlapping, incomplete and sound."""
    a = exam.audits(spark, d)
    r = bundle.resume_bundles(_scopes(a), checkpoints(a))
    m = F.pmod(F.length("run_id") + F.col("pass_number") + F.size("remaining"), F.lit(4))
    now = F.when(m == 1, F.concat("remaining", F.slice("completed", 1, 1))).when(m == 2, F.slice("remaining", 2, 100)).otherwise(F.col("remaining"))
    responses = r.select("run_id", "pass_number", (F.col("sequence") - (m == 0).cast("int")).alias("resume_sequence"), now.alias("completed_now"))
    out = bundle.merge_resumed(r, responses)
    return out.select("run_id", "pass_number", "status", F.array_join(F.col("merged").cast("array<string>"), ",").alias("merged"))


@query("""SELECT run_id, pass_number, status, CASE WHEN status = 'appended' THEN sequence + 1 END::BIGINT AS sequence, CASE WHEN status = 'appended' THEN sha256('{"completed_subject_ids":[' || array_to_string(now, ',') || '],"pass_id":"' || run_id || '/' || pass_number || '","sequence":' || (sequence + 1) || '}') END AS checkpoint_sha256
FROM (SELECT run_id, pass_number, sequence, now, CASE WHEN len(list_filter(completed, lambda x: NOT list_contains(now, x))) > 0 THEN 'conflict' ELSE 'appended' END AS status FROM (
  SELECT nc.run_id, nc.pass_number, nc.sequence, nc.completed, coalesce(list(subject_id ORDER BY subject_id) FILTER (CASE WHEN exam_id % 3 = 0 THEN subject_id % 60 >= 30 ELSE subject_id % 60 < 50 END), []) AS now FROM nc JOIN sc USING (run_id, pass_number) GROUP BY ALL))""", RESUME)
def checkpoint_append(spark, d):
    a = exam.audits(spark, d)
    wanted = F.when(F.expr("exam_id % 3 = 0"), F.expr(f"subject_id % {exam.SIZE} >= 30")).otherwise(F.expr(f"subject_id % {exam.SIZE} < 50"))
    incoming = a.where("not completed and pass_number % 2 = 0").groupBy("run_id", "pass_number").agg(F.array_sort(F.collect_list(F.when(wanted, F.col("subject_id")))).alias("completed"))
    return bundle.append_checkpoints(checkpoints(a), incoming)


# --- ingest ----------------------------------------------------------------------------------

FAULTS = 12


def _fault():
    return F.pmod(F.col("exam_id") * 5 + F.length("run_id") + F.substring("created_at", 1, 4).cast("int") + F.col("pass_number") * 3, F.lit(FAULTS))


def _answered(spark, a):
    """Done passes with their verdicts and findings, stored: responses and passes both come from these rows, which are much shorter than the texts."""
    parts = F.transform(F.array_sort("found"), lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "score", "occ_id", "category", "summary")]))
    verdict = F.struct("subject_id", F.concat(F.lit("q"), F.col("subject_id")).alias("subject"), "verdict", parts.alias("found"))
    per = a.where("completed").groupBy("exam_id", "run_id", "created_at", "pass_number").agg(F.array_sort(F.collect_list(verdict)).alias("v"))
    return sinks.snapshot(per.select(F.concat_ws("/", "run_id", "pass_number").alias("pass_id"), _fault().alias("fault"), "v"), scratch(spark, "answered"), "1")


def responses(rows):
    """A response for every done pass; some have a fault. Also the passes they answer."""
    key, kind = F.col("pass_id"), F.col("fault")
    rows = rows.repartition("pass_id")  # before the texts are made, which are joined by this key

    def finding(subject, x):
        identity = F.struct(F.lit("Answer \t Key").alias("field"), x["kind"].alias("observed"), F.lit("Ｆ ").alias("expected"))
        severity = F.when(x["score"] == 15, "low").when(x["score"] == 35, "medium").when(x["score"] == 65, "high").otherwise("critical")
        return F.struct(subject.alias("subject_id"), x["category"].alias("category"), F.when(kind == 6, "fatal").otherwise(severity).alias("severity"), x["summary"].alias("summary"), F.lit("").alias("detail"), identity.alias("identity"), F.struct(x["occ_id"].alias("page")).alias("evidence"))

    ids = F.transform("v", lambda x: x["subject"])
    confidence = F.when(kind == 5, 2.0).otherwise(0.5)
    verdict = lambda x: F.struct(x["subject"].alias("subject_id"), F.when(kind == 8, "clear").otherwise(x["verdict"]).alias("verdict"), confidence.alias("confidence"), F.lit("").alias("rationale"))
    said = F.transform("v", verdict)
    f = F.flatten(F.transform("v", lambda x: F.transform(x["found"], lambda y: finding(x["subject"], y))))
    f = F.when(kind == 7, F.concat(f, f)).otherwise(f)
    doc = F.struct(
        F.when(kind == 3, F.concat(ids, ids)).otherwise(ids).alias("completed_subject_ids"), F.when(kind == 2, "other").otherwise(bundle.CONTRACT).alias("contract_version"), f.alias("findings"),
        F.sha2(key, 256).alias("input_sha256"), F.array(F.lit("n")).alias("notes"), key.alias("pass_id"), F.when(kind == 4, F.slice(said, 2, 1000)).otherwise(said).alias("verdicts"),
    )
    text = F.to_json(doc)
    raw = F.when(kind == 0, F.concat(text, F.lit("}"))).when(kind == 1, F.concat(F.regexp_replace(text, "\\}$", ""), F.lit(',"extra":1}'))).otherwise(text)
    passes = rows.select(key, F.lit(bundle.CONTRACT).alias("contract"), F.sha2(key, 256).alias("input_sha256"), ids.alias("subjects"))
    return rows.select(key, raw.alias("raw")), passes


INGEST = exam.SQL + f""", ft AS (SELECT exam_id, run_id, pass_number, run_id || '/' || pass_number AS pass_id, (exam_id * 5 + length(run_id) + substr(created_at, 1, 4)::INT + pass_number * 3) % {FAULTS} AS fault, count(*) AS n FROM vd GROUP BY ALL),
fe AS (SELECT ft.*, CASE fault WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'result_fields' WHEN 2 THEN 'contract_or_pass' WHEN 3 THEN 'completed_scope' WHEN 4 THEN 'verdict_coverage' WHEN 5 THEN 'verdict_confidence' WHEN 6 THEN CASE WHEN nf > 0 THEN 'finding_severity' END WHEN 7 THEN CASE WHEN nf > 0 THEN 'duplicate_fingerprint' END WHEN 8 THEN CASE WHEN nf > 0 THEN 'finding_without_verdict' END END AS error
  FROM ft LEFT JOIN (SELECT run_id, pass_number, count(*) AS nf FROM oc GROUP BY run_id, pass_number) USING (run_id, pass_number))
"""


def _ingested(spark, d):
    return ingest.ingest(*responses(_answered(spark, exam.audits(spark, d))))


@query("SELECT pass_id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'invalid' END AS status, error FROM fe", INGEST)
def ingest_attempts(spark, d):
    return _ingested(spark, d)[2].select("pass_id", "status", "error")


@query("""SELECT pass_id, 1 AS attempt_number, 'timed_out' AS status, 'no_answer' AS error FROM fe WHERE fault % 2 = 0 UNION ALL SELECT pass_id, 2 - fault % 2, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'invalid' END, error FROM fe
UNION ALL SELECT pass_id, 3 - fault % 2, 'failed', 'again' FROM fe WHERE error IS NOT NULL""", INGEST)
def streamed_attempts(spark, d):
    """Events of every pass as a stream of two batches: a time-out for half of them, the response, the same file again, and a failure, which passes with a result refuse."""
    answered, root = _answered(spark, exam.audits(spark, d)), files.scratch(spark, "attempts")
    rows, passes = responses(answered)

    def send(part, number, kind, raw, code):
        at = F.timestamp_seconds(F.lit(1_700_000_000 + number))
        part.select("pass_id", F.lit(number).cast("long").alias("number"), at.alias("at"), F.lit(kind).alias("kind"), raw.alias("raw"), F.lit(code).cast("string").alias("error_code"), F.lit(None).cast("array<string>").alias("completed")).write.mode("append").parquet(f"{root}/events")

    def sent():
        return spark.read.schema(attempts.EVENT).parquet(f"{root}/events")

    send(answered.where("fault % 2 = 0"), 1, "timed_out", F.lit(None).cast("string"), "no_answer")
    send(rows, 2, "response", F.col("raw"), None)
    half = len(sent().inputFiles())
    sent().where("kind = 'response'").write.mode("append").parquet(f"{root}/events")
    send(answered, 3, "failed", F.lit(None).cast("string"), "again")
    attempts.ingest_stream(spark, f"{root}/events", passes, f"{root}/out", f"{root}/state", files_each=max(half, len(sent().inputFiles()) - half), buckets=answered.count() // 64 + 1).awaitTermination()
    return attempts.ingested(spark, f"{root}/out", "attempts").select("pass_id", F.col("attempt_number").cast("int").alias("attempt_number"), "status", "error")


@query("SELECT pass_id, 'q' || subject_id AS subject, CASE WHEN fault = 8 THEN 'clear' ELSE verdict END AS verdict, 0.5::DOUBLE AS confidence, row_number() OVER (PARTITION BY pass_id ORDER BY subject_id) AS position FROM vd JOIN fe USING (run_id, pass_number) WHERE error IS NULL", INGEST)
def ingest_verdicts(spark, d):
    return _ingested(spark, d)[0].select("pass_id", "subject", "verdict", "confidence", F.col("position").cast("long").alias("position"))


FINGERPRINT = """sha256('{"identity":{"expected":"f","field":"answer key","observed":' || kind || '},"subject_id":"q' || subject_id || '"}')"""


@query(f"SELECT pass_id, 'q' || subject_id AS subject, category, CASE score WHEN 15 THEN 'low' WHEN 35 THEN 'medium' WHEN 65 THEN 'high' ELSE 'critical' END AS severity, summary, {FINGERPRINT} AS fingerprint FROM oc JOIN fe USING (run_id, pass_number) WHERE error IS NULL", INGEST)
def ingest_occurrences(spark, d):
    return _ingested(spark, d)[1].select("pass_id", "subject", "category", "severity", "summary", "fingerprint")


@query(f"""SELECT pass_id, completed, verdicts, coalesce(fingerprints, '') AS fingerprints FROM fe JOIN (SELECT run_id, pass_number, string_agg('q' || subject_id, ',' ORDER BY subject_id) AS completed, string_agg('q' || subject_id || '=' || verdict, ',' ORDER BY subject_id) AS verdicts FROM vd GROUP BY ALL) USING (run_id, pass_number)
LEFT JOIN (SELECT run_id, pass_number, string_agg(fp, ',' ORDER BY subject_id, fp) AS fingerprints FROM (SELECT *, {FINGERPRINT} AS fp FROM oc) GROUP BY run_id, pass_number) USING (run_id, pass_number) WHERE error IS NULL AND fault NOT IN (7, 8)
UNION ALL SELECT pass_id, completed, verdicts, '' FROM fe JOIN (SELECT run_id, pass_number, string_agg('q' || subject_id, ',' ORDER BY subject_id) AS completed, string_agg('q' || subject_id || '=' || CASE WHEN fault = 8 THEN 'clear' ELSE verdict END, ',' ORDER BY subject_id) AS verdicts FROM vd JOIN ft USING (run_id, pass_number) GROUP BY ALL) USING (run_id, pass_number) WHERE error IS NULL AND fault IN (7, 8)""", INGEST)
def result_normal_form(spark, d):
    n = ingest.normal_result(ingest.read_responses(*responses(_answered(spark, exam.audits(spark, d)))))
    return n.select("pass_id", *[F.array_join(c, ",").alias(c) for c in ("completed", "verdicts", "fingerprints")])


@query("""SELECT event_id, sha256('{"identity":' || i || ',"subject_id":"u' || user_id || '"}') AS fingerprint, sha256('{"category":"' || event_type || '","identity":' || i || ',"subject_id":"u' || user_id || '"}') AS legacy_fingerprint, i AS identity
FROM (SELECT *, '{"expected":"' || event_type || ' ok","field":"strasse","observed":[' || json_extract_string(props, '$.k') || ',1.0,null]}' AS i FROM events)""")
def finding_fingerprints(spark, d):
    """Fingerprints by both versions; the identity comes from the evidence where none is given."""
    text = F.concat(F.lit('{"category":"c","evidence":{"other":1,"observed":['), F.get_json_object("props", "$.k"), F.lit(',1.0,null],"field":" Straße ","expected":"'), F.upper("event_type"), F.lit('  ok"}}'))
    rows = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("u"), "user_id").alias("subject"), jsonx.finding_identity(text).alias("identity"))
    return rows.select("event_id", jsonx.fingerprint_of(F.col("subject"), F.col("identity")).alias("fingerprint"), jsonx.fingerprint_of(F.col("subject"), F.col("identity"), F.col("event_type")).alias("legacy_fingerprint"), "identity")


@query("""SELECT event_id, '{"a":[1.0,"é"],"k":' || json_extract_string(props, '$.k') || ',"z":{}}' AS canonical FROM events""")
def canonical_json(spark, d):
    text = F.concat(F.lit('{ "z":{}, "k": '), F.get_json_object("props", "$.k"), F.lit(', "a" : [1.0, "\\u00e9"] }'))
    return table(spark, d, "events").select("event_id", jsonx.canonical_json(text).alias("canonical"))
