"""Queries of the review side: lists, details, bundles, audio, and saves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import report, review
from tidemark.operators.bundle import shared_partner
from tidemark.plans import exam
from tidemark.plans.audit_catalog import LEVEL, SUMMARY, attempts, checkpoints
from tidemark.plans.ingest_catalog import DOCS
from tidemark.plans.registry import query, table

JOINED = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(f"""SELECT q.subject_id, q.exam_id, number, section, status, requires_image, run_id, total, clear, finding, uncertain, n_findings, disagreement, risk_score, CASE WHEN run_id IS NOT NULL THEN {LEVEL.format('risk_score')} END AS risk_level, converged, incomplete_passes
FROM q LEFT JOIN ns USING (subject_id) LEFT JOIN (SELECT run_id, count(DISTINCT pass_number) FILTER (NOT completed) AS incomplete_passes FROM sc GROUP BY run_id) USING (run_id)""", SUMMARY)
def question_list(spark, d):
    q, a = exam.questions(spark, d), exam.audits(spark, d)
    log = attempts(a)
    execution = report.execution_summary(log, report.pass_status(a, checkpoints(a), log)).select("run_id", "incomplete_passes")
    return review.question_list(q, report.newest_summaries(a), execution)


@query("SELECT exam_id, count(*) AS total, count(*) FILTER (status = 'needs_manual_review') AS needs_manual_review, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected FROM q GROUP BY exam_id", exam.SQL)
def question_status_counts(spark, d):
    return review.status_counts(exam.questions(spark, d))


HISTORIES = """, hs AS (SELECT subject_id, any_value(n) AS version, list({note: note, reviewed_at: reviewed_at, scope: scope, status: status} ORDER BY k) FILTER (k <= 30) AS history FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY id DESC) AS k, count(*) OVER (PARTITION BY subject_id) AS n FROM rec) GROUP BY subject_id),
ai AS (SELECT seg.*, round_even(duration_seconds * 1000, 0)::BIGINT AS source_duration_ms, source_sha256, CASE WHEN number IN (25, 26) THEN [25, 26] WHEN number IN (27, 28) THEN [27, 28] WHEN number IN (29, 30) THEN [29, 30] ELSE [number] END AS shared_questions,
  CASE WHEN segment_status = 'verified' AND clip IS NOT NULL THEN '/media/' || subject_id || '/clip' END AS clip_url FROM seg JOIN asst USING (exam_id) WHERE duration_seconds IS NOT NULL)
"""


@query("SELECT subject_id, version, len(history) AS shown, history[1].note AS newest_note, history[1].status AS newest_status, string_agg(r.note, '|' ORDER BY r.i) AS notes FROM (SELECT *, unnest(list_transform(range(1, len(history) + 1), lambda i: {i: i, note: history[i].note})) AS r FROM hs) GROUP BY ALL", exam.SQL + HISTORIES)
def review_histories(spark, d):
    h = review.histories(exam.records(spark, d))
    first = F.get("history", F.lit(0))
    return h.select("subject_id", "version", F.size("history").cast("long").alias("shown"), first["note"].alias("newest_note"), first["status"].alias("newest_status"), F.array_join(F.transform("history", lambda x: x["note"]), "|").alias("notes"))


@query("SELECT subject_id, start_ms, end_ms, segment_status, version, source_duration_ms, array_to_string(shared_questions, ',') AS shared_questions, clip_url FROM ai", exam.SQL + HISTORIES)
def audio_info(spark, d):
    q = exam.questions(spark, d)
    return review.audio_info(q, exam.assets(q), exam.segments(q)).select("subject_id", "start_ms", "end_ms", "segment_status", "version", "source_duration_ms", JOINED("shared_questions"), "clip_url")


DETAILS = DOCS + HISTORIES + """, dt AS (SELECT q.exam_id, number, subject_id, coalesce(hs.version, 0) AS version, to_json({answer: {choice_number: choice_number, source_page: answer_page}, answer_url: '/media/' || subject_id || '/answer#page=' || answer_page,
    audio_segment: CASE WHEN ai.end_ms IS NOT NULL THEN {clip_url: clip_url, end_ms: ai.end_ms, shared_questions: shared_questions, source_duration_ms: source_duration_ms, start_ms: ai.start_ms, status: segment_status, version: ai.version} END, choices: cs,
    "group": {"end": last_number, instruction: coalesce(instruction, ''), start: first_number}, history: coalesce(history, []), id: subject_id, images: coalesce(ims, []), number: number, points: points, requires_image: requires_image, review_status: q.status, section: section, stem: stem,
    transcript: CASE WHEN dialogue IS NOT NULL THEN {review_status: transcript_status, text: dialogue, warnings: CASE WHEN warnings_json = '["shared"]' THEN ['shared'] ELSE [] END} END, version: coalesce(hs.version, 0)})::VARCHAR AS doc
  FROM q LEFT JOIN (SELECT subject_id, list({number: choice, text: text} ORDER BY choice) AS cs FROM ch GROUP BY subject_id) USING (subject_id) JOIN an USING (subject_id) LEFT JOIN gr ON gr.exam_id = q.exam_id AND gr.g = (number - 1) // 10
  LEFT JOIN tr USING (subject_id) LEFT JOIN (SELECT subject_id, list({key: image_key, url: '/media/' || subject_id || '/image/' || k} ORDER BY k) AS ims FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY image_key) - 1 AS k FROM im) GROUP BY subject_id) USING (subject_id)
  LEFT JOIN (SELECT * EXCLUDE (exam_id, number) FROM ai) ai USING (subject_id) LEFT JOIN hs USING (subject_id))
"""


def _details(spark, d):
    q = exam.questions(spark, d)
    return review.question_details(q, exam.choices(q), exam.answers(q), exam.groups(q), exam.transcripts(q), exam.images(q), exam.assets(q), exam.segments(q), exam.records(spark, d))


@query("SELECT subject_id, version, doc FROM dt", DETAILS)
def question_detail(spark, d):
    return _details(spark, d).select("subject_id", "version", "doc")


@query("""SELECT exam_id, count(*) AS total_questions, sha256('{"exam_id":' || exam_id || ',"questions":{' || string_agg('"' || subject_id || '":' || doc, ',' ORDER BY number) || '},"total_questions":' || count(*) || '}') AS bundle_sha256 FROM dt GROUP BY exam_id""", DETAILS)
def session_bundle(spark, d):
    return review.session_bundles(_details(spark, d)).select("exam_id", "total_questions", F.sha2("bundle", 256).alias("bundle_sha256"))


# --- saves -------------------------------------------------------------------------------------

PAYLOADS = exam.SQL + """, vs AS (SELECT subject_id, count(*) AS stored FROM rec GROUP BY subject_id),
pl AS (SELECT q.*, coalesce(stored, 0) AS stored, subject_id % 11 AS k, dialogue FROM q LEFT JOIN vs USING (subject_id) LEFT JOIN tr USING (subject_id))
"""


@query("""SELECT subject_id, outcome, fault, CASE WHEN outcome = 'saved' THEN stem || '!' ELSE stem END AS stem, CASE WHEN outcome = 'saved' AND k <> 8 THEN 'verified' ELSE status END AS status, CASE WHEN outcome = 'saved' AND k <> 8 THEN upper(dialogue) ELSE dialogue END AS transcript_text, stored + CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END AS version, outcome = 'saved' AS has_record
FROM (SELECT *, CASE WHEN k < 7 OR k = 8 AND status = 'rejected' THEN 'invalid' WHEN k = 7 THEN 'conflict' WHEN k = 8 THEN 'unchanged' ELSE 'saved' END AS outcome, CASE k WHEN 0 THEN 'version' WHEN 1 THEN 'status' WHEN 2 THEN 'choices' WHEN 3 THEN CASE WHEN requires_image THEN NULL ELSE 'blank_choices' END WHEN 4 THEN 'transcript' WHEN 5 THEN 'note' WHEN 6 THEN 'rejection_reason' WHEN 8 THEN CASE WHEN status = 'rejected' THEN 'rejection_reason' END END AS fault FROM pl) WHERE NOT (k = 3 AND requires_image)
UNION ALL SELECT subject_id, 'saved', NULL, stem || '!', 'verified', upper(dialogue), stored + 1, true FROM pl WHERE k = 3 AND requires_image""", PAYLOADS)
def review_save(spark, d):
    """A payload for every question: eleven kinds, from faults to conflicts, no changes and changes.

    The unchanged kind has no note, so for a rejected question it lacks the reason.
    """
    q = exam.questions(spark, d)
    versions = exam.records(spark, d).groupBy("subject_id").agg(F.count(F.lit(1)).alias("version"))
    c, t = exam.choices(q), exam.transcripts(q)
    k = F.expr("subject_id % 11")
    rows = q.join(versions, "subject_id", "left").join(t.select("subject_id", "dialogue"), "subject_id", "left")
    rows = rows.join(c.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("choice", "text"))), lambda x: x["text"]).alias("own")), "subject_id")
    stored = F.coalesce("version", F.lit(0).cast("long"))
    four = F.when(k == 2, F.slice("own", 1, 3)).when(k == 3, F.array(*[F.lit(" ")] * 4)).otherwise(F.col("own"))
    text = F.when(k == 4, F.when(F.col("section") == "listening", F.lit(" ")).otherwise("x")).when(k == 8, F.col("dialogue")).otherwise(F.upper("dialogue"))
    payloads = rows.select(
        "subject_id", F.when(k == 0, -1).when(k == 7, stored + 1).otherwise(stored).alias("version"), F.when(k == 1, "done").when(k == 6, "rejected").when(k == 8, F.col("status")).otherwise("verified").alias("status"),
        F.when(k == 8, F.col("stem")).otherwise(F.concat("stem", F.lit("!"))).alias("stem"), four.alias("choices"), text.alias("transcript_text"), F.when(k == 5, F.repeat(F.lit("n"), 4001)).when((k == 8) | (k == 6), " ").otherwise("seen").alias("note"),
    )
    out = review.save_reviews(q, c, t, versions, payloads)
    return out.select("subject_id", "outcome", "fault", "stem", "status", "transcript_text", "version", F.col("evidence").isNotNull().alias("has_record"))


SEGMENTS = exam.SQL + """, sp AS (SELECT seg.subject_id AS payload_id, exam_id, number, subject_id % 8 AS k, CASE subject_id % 8 WHEN 0 THEN start_ms WHEN 1 THEN start_ms + 7 ELSE start_ms + 5 END AS s, CASE subject_id % 8 WHEN 0 THEN end_ms WHEN 2 THEN start_ms + 400 WHEN 3 THEN 99999999 ELSE end_ms + 5 END AS e, segment_status AS st, CASE WHEN subject_id % 8 = 5 THEN version + 1 ELSE version END AS seen, subject_id % 8 <> 6 AS same_source FROM seg),
sf AS (SELECT sp.*, CASE WHEN e - s < 500 THEN 'bounds' WHEN duration_seconds IS NULL OR e > round_even(duration_seconds * 1000, 0) THEN 'beyond_source' WHEN NOT same_source THEN 'source_changed' END AS fault FROM sp JOIN asst USING (exam_id)),
sx AS (SELECT sf.*, q.subject_id, seg.start_ms, seg.end_ms, seg.segment_status, seg.version, seg.clip FROM sf JOIN q ON q.exam_id = sf.exam_id AND q.number IN (sf.number, CASE WHEN sf.number >= 25 THEN sf.number + CASE WHEN sf.number % 2 = 1 THEN 1 ELSE -1 END ELSE sf.number END) LEFT JOIN seg ON seg.subject_id = q.subject_id),
sy AS (SELECT *, CASE WHEN fault IS NOT NULL THEN 'invalid' WHEN bool_or(coalesce(version, 0) <> seen) OVER (PARTITION BY payload_id) THEN 'conflict' WHEN bool_or(version IS NULL) OVER (PARTITION BY payload_id) AND st = 'verified' THEN 'not_previewed' WHEN coalesce(start_ms = s AND end_ms = e AND segment_status = st, false) THEN 'unchanged' ELSE 'saved' END AS outcome FROM sx)
"""


@query("SELECT payload_id, subject_id, outcome, fault, CASE WHEN outcome = 'saved' THEN s ELSE start_ms END AS start_ms, CASE WHEN outcome = 'saved' THEN e ELSE end_ms END AS end_ms, CASE WHEN outcome = 'saved' THEN st ELSE segment_status END AS segment_status, CASE WHEN outcome = 'saved' THEN coalesce(version + 1, 1) ELSE version END::BIGINT AS version, CASE WHEN outcome <> 'saved' THEN clip END AS clip, CASE WHEN outcome = 'saved' THEN to_json({after: {end_ms: e, start_ms: s, status: st}, before: CASE WHEN version IS NOT NULL THEN {end_ms: end_ms, start_ms: start_ms, status: segment_status} END})::VARCHAR END AS evidence FROM sy", SEGMENTS)
def segment_save(spark, d):
    """A payload for every stored segment, of eight kinds."""
    q = exam.questions(spark, d)
    s, assets = exam.segments(q), exam.assets(q)
    k = F.expr("subject_id % 8")
    payloads = s.join(assets.select("exam_id", "source_sha256"), "exam_id").select(
        "subject_id", (F.col("version") + (k == 5).cast("int")).alias("version"), (F.col("start_ms") + F.when(k == 0, 0).when(k == 1, 7).otherwise(5)).alias("start_ms"),
        F.when(k == 0, F.col("end_ms")).when(k == 2, F.col("start_ms") + 400).when(k == 3, 99_999_999).otherwise(F.col("end_ms") + 5).alias("end_ms"), "segment_status", F.when(k == 6, "other").otherwise(F.col("source_sha256")).alias("source_sha256"),
    )
    return review.save_segments(q, assets, s, payloads).withColumn("version", F.col("version").cast("long"))


@query("SELECT exam_id, CASE WHEN number < 25 THEN number ELSE 25 + 2 * ((number - 25) // 2) END::INT AS first, count(*) AS questions, count(DISTINCT {a: start_ms, b: end_ms, c: segment_status, d: version, e: clip}) AS states FROM seg GROUP BY ALL HAVING states > 1", exam.SQL)
def clip_identity(spark, d):
    return review.clip_identity(exam.segments(exam.questions(spark, d)))


@query("""SELECT subject_id, CASE WHEN exam_id % 3 = 0 THEN 'stale_source' WHEN seg.start_ms IS NOT NULL THEN 'kept' ELSE 'registered' END AS action, CASE WHEN exam_id % 3 <> 0 THEN coalesce(seg.start_ms, p) END AS start_ms
FROM (SELECT subject_id, exam_id, number, 1000 * CASE WHEN number < 25 THEN number ELSE 25 + 2 * ((number - 25) // 2) END AS p FROM q WHERE section = 'listening') LEFT JOIN (SELECT subject_id, start_ms FROM seg) seg USING (subject_id)""", exam.SQL)
def candidate_registration(spark, d):
    q = exam.questions(spark, d)
    rows = q.where("section = 'listening'").withColumn("questions", shared_partner(F.col("number"))).where("questions[0] = number or not exists(questions, x -> x < number)")
    # an exam may end within a pair, and the proposal of its first question covers it
    rows = rows.join(exam.assets(q).select("exam_id", "source_sha256"), "exam_id")
    p = rows.select("exam_id", "questions", (F.col("number") * 1000).alias("start_ms"), (F.col("number") * 1000 + 900).alias("end_ms"), F.when(F.expr("exam_id % 3 = 0"), "old").otherwise(F.col("source_sha256")).alias("source_sha256"))
    return review.register_candidates(p, q, exam.segments(q), exam.assets(q))


@query("SELECT DISTINCT subject_id, CASE WHEN image_key IN ('img-5', 'img-17', 'img-101') THEN image_key || '-v2' ELSE image_key END AS image_key FROM im", exam.SQL)
def image_relink(spark, d):
    renames = spark.createDataFrame([(k, f"{k}-v2") for k in ("img-5", "img-17", "img-101")], "old_key string, new_key string")
    return review.relink_images(exam.images(exam.questions(spark, d)), renames)


@query("SELECT c_custkey, coalesce(total, total2) AS total, clear, finding FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE (c_custkey % 50)::BIGINT END AS total, clear, finding, (clear + finding)::BIGINT AS total2 FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END::BIGINT AS clear, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 9 END::BIGINT AS finding FROM customer))")
def summary_normalised(spark, d):
    """Counts of summary documents: wrong types and negative numbers count as 0, a missing total is derived."""
    key = F.col("c_custkey")
    said = lambda x: x.cast("string")
    total = F.when(key % 4 == 1, F.element_at(F.array(F.lit('"7"'), F.lit("-1"), F.lit("2.5")), (key % 3 + 1).cast("int"))).otherwise(said(key % 50))
    clear = F.when(key % 3 == 0, "true").otherwise(said(key % 7))
    finding = F.when(key % 5 == 0, '"4"').otherwise(said(key % 9))
    doc = F.concat(F.lit('{"total":'), total, F.lit(',"totals":{"clear":'), clear, F.lit('},"finding":'), finding, F.lit("}"))
    rows = table(spark, d, "customer").select("c_custkey", F.parse_json(doc).alias("v"))
    return rows.select("c_custkey", *review.normal_counts(F.col("v"), ("clear", "finding")))
