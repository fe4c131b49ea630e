"""The review side: question list, detail, session bundle, audio, and the saving of reviews and segments.

Relations are those of ``plans.exam``. Saves are pure functions of the stored rows and
the payloads; each payload gets a status, and only sound ones change rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bundle import list_of, shared_partner, to_json

STATUSES = ("needs_manual_review", "verified", "rejected")
MANUAL = "manual_question_review"
HISTORY = 30
SHORTEST_MS, LONGEST_MS = 500, 10 * 60 * 1000
LIMITS = {"stem": 10_000, "choice": 10_000, "transcript": 20_000, "note": 4000}


def note_of(evidence: Column) -> Column:
    """The note of a record's evidence; empty where the evidence is no JSON object or has none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(evidence), "$.note", "string"), F.lit(""))


def histories(records: DataFrame) -> DataFrame:
    """``subject_id, version, history``: all records counted, and the newest thirty, newest first."""
    k = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("id")))
    # the limit is applied before the shuffle too, so a task holds no more than thirty records of a subject from each part
    newest = records.withColumn("k", k).where(F.col("k") <= HISTORY).withColumn("note", note_of(F.col("evidence")))
    listed = newest.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("k", "note", "reviewed_at", "scope", "status"))).alias("h"))
    got = records.groupBy("subject_id").agg(F.count(F.lit(1)).alias("version")).join(listed, "subject_id")
    return got.select("subject_id", "version", F.transform("h", lambda x: F.struct(x["note"].alias("note"), x["reviewed_at"].alias("reviewed_at"), x["scope"].alias("scope"), x["status"].alias("status"))).alias("history"))


def audio_info(q: DataFrame, assets: DataFrame, segments: DataFrame) -> DataFrame:
    """Per listening question with a timed asset and a segment: interval, shared questions and clip."""
    timed = assets.where("duration_seconds is not null").select("exam_id", F.bround(F.col("duration_seconds") * 1000).cast("long").alias("source_duration_ms"), "source_sha256")
    rows = q.where("section = 'listening'").select("subject_id", "exam_id").join(timed, "exam_id").join(segments.drop("exam_id"), "subject_id")
    clip = F.when((F.col("segment_status") == "verified") & F.col("clip").isNotNull(), F.concat(F.lit("/media/"), "subject_id", F.lit("/clip")))
    return rows.withColumns({"shared_questions": shared_partner(F.col("number")), "clip_url": clip})


def question_list(q: DataFrame, summaries: DataFrame, executions: DataFrame) -> DataFrame:
    """Questions with the short form of their newest audit summary and of its execution."""
    keys = ["run_id", "total", "clear", "finding", "uncertain", "n_findings", "disagreement", "risk_score", "risk_level", "converged"]
    audit = summaries.select("subject_id", *keys).join(executions, "run_id", "left")
    return q.select("subject_id", "exam_id", "number", "section", "status", "requires_image").join(audit, "subject_id", "left")


def status_counts(q: DataFrame) -> DataFrame:
    return q.groupBy("exam_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def question_details(q, choices, answers, groups, transcripts, images, assets, segments, records) -> DataFrame:
    """``exam_id, number, subject_id, version, doc``: what a reviewer sees of each question, as JSON."""
    rows = q.withColumn("g", F.expr("(number - 1) div 10"))
    rows = rows.join(list_of(choices, "subject_id", "choice", F.struct(F.col("choice").alias("number"), "text"), "choices"), "subject_id", "left").join(answers, "subject_id")
    rows = rows.join(groups.select("exam_id", "g", "first_number", "instruction", "last_number"), ["exam_id", "g"], "left")
    warnings = F.coalesce(F.from_json("warnings_json", "array<string>"), F.array().cast("array<string>"))
    rows = rows.join(transcripts.select("subject_id", F.struct(F.col("transcript_status").alias("review_status"), F.col("dialogue").alias("text"), warnings.alias("warnings")).alias("transcript")), "subject_id", "left")
    rows = rows.join(list_of(images, "subject_id", "image_key", F.col("image_key"), "images"), "subject_id", "left")
    a = audio_info(q, assets, segments)
    rows = rows.join(a.select("subject_id", F.struct("clip_url", "end_ms", "shared_questions", "source_duration_ms", "start_ms", F.col("segment_status").alias("status"), "version").alias("audio_segment")), "subject_id", "left")
    rows = rows.join(histories(records), "subject_id", "left")
    version = F.coalesce("version", F.lit(0).cast("long"))
    none = F.array().cast(rows.schema["history"].dataType)
    url = lambda kind, page: F.concat(F.lit("/media/"), "subject_id", F.lit(f"/{kind}#page="), page)
    pictures = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda key, i: F.struct(key.alias("key"), F.concat(F.lit("/media/"), F.col("subject_id"), F.lit("/image/"), i).alias("url")))
    doc = F.struct(
        F.struct("choice_number", F.col("answer_page").alias("source_page")).alias("answer"), url("answer", "answer_page").alias("answer_url"), "audio_segment", "choices",
        F.struct(F.col("last_number").alias("end"), F.coalesce("instruction", F.lit("")).alias("instruction"), F.col("first_number").alias("start")).alias("group"), F.coalesce("history", none).alias("history"),
        F.col("subject_id").alias("id"), pictures.alias("images"), "number", "points", "requires_image", F.col("status").alias("review_status"), "section", "stem", "transcript", version.alias("version"),
    )
    return rows.select("exam_id", "number", "subject_id", version.alias("version"), to_json(doc).alias("doc"))


def session_bundles(details: DataFrame) -> DataFrame:
    """All questions of an exam in one document."""
    rows = list_of(details, "exam_id", "number", F.concat(F.lit('"'), F.col("subject_id"), F.lit('":'), F.col("doc")), "d")
    body = F.concat(F.lit('{"exam_id":'), F.col("exam_id").cast("string"), F.lit(',"questions":{'), F.array_join("d", ","), F.lit('},"total_questions":'), F.size("d").cast("string"), F.lit("}"))
    return rows.select("exam_id", F.size("d").cast("long").alias("total_questions"), body.alias("bundle"))


# --- saving ------------------------------------------------------------------------------


def _first(faults: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(code)) for code, bad in faults.items()])


def _blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s", " ")) == ""


def save_reviews(q: DataFrame, choices: DataFrame, transcripts: DataFrame, versions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Classifies payloads and gives the rows and the record that result.

    ``payloads``: subject_id, version, status, stem, choices (array of strings),
    transcript_text, note. ``versions``: subject_id, version. A payload that changes
    nothing and has no note leaves no record.
    """
    old = q.select("subject_id", F.col("stem").alias("old_stem"), F.col("status").alias("old_status"), "requires_image")
    old = old.join(list_of(choices, "subject_id", "choice", F.col("text"), "old_choices"), "subject_id", "left")
    old = old.join(transcripts.select("subject_id", F.col("dialogue").alias("old_transcript")), "subject_id", "left")
    rows = payloads.join(old, "subject_id").join(versions.withColumnRenamed("version", "stored"), "subject_id", "left")
    text, c = F.col("transcript_text"), F.col("choices")
    fault = _first({
        "version": F.coalesce(F.col("version") < 0, F.lit(True)),
        "status": F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True)),
        "stem": F.coalesce(F.length("stem") > LIMITS["stem"], F.lit(True)),
        "choices": F.coalesce((F.size(c) != 4) | F.exists(c, lambda x: F.coalesce(F.length(x) > LIMITS["choice"], F.lit(True))), F.lit(True)),
        "blank_choices": F.forall(c, _blank) & ~F.col("requires_image"),
        "transcript": F.when(F.col("old_transcript").isNotNull(), F.coalesce(_blank(text) | (F.length(text) > LIMITS["transcript"]), F.lit(True))).otherwise(text.isNotNull()),
        "note": F.coalesce(F.length("note") > LIMITS["note"], F.lit(True)),
        "rejection_reason": (F.col("status") == "rejected") & _blank(F.col("note")),
    })
    rows = rows.withColumns({"fault": fault, "stored": F.coalesce("stored", F.lit(0).cast("long"))})
    changed = ~((F.col("stem") == F.col("old_stem")) & (c == F.col("old_choices")) & text.eqNullSafe(F.col("old_transcript")) & (F.col("status") == F.col("old_status")))
    outcome = F.when(F.col("fault").isNotNull(), "invalid").when(F.col("stored") != F.col("version"), "conflict").when(changed | ~_blank(F.col("note")), "saved").otherwise("unchanged")
    rows = rows.withColumn("outcome", outcome)
    saved = F.col("outcome") == "saved"
    state = lambda *names: F.struct(*[F.col(n).alias(a) for a, n in zip(("choices", "status", "stem", "transcript_text"), names)])
    record = to_json(F.struct(state("choices", "status", "stem", "transcript_text").alias("after"), state("old_choices", "old_status", "old_stem", "old_transcript").alias("before"), "note"))
    return rows.select(
        "subject_id", "outcome", "fault", *[F.when(saved, F.col(n)).otherwise(F.col(f"old_{n}")).alias(n) for n in ("stem", "status", "choices")], F.when(saved & F.col("old_transcript").isNotNull(), text).otherwise(F.col("old_transcript")).alias("transcript_text"),
        (F.col("stored") + saved.cast("long")).alias("version"), F.when(saved, record).alias("evidence"),
    )


def save_segments(q: DataFrame, assets: DataFrame, segments: DataFrame, payloads: DataFrame) -> DataFrame:
    """Applies intervals to all questions of a shared recording, or to none of them.

    ``payloads``: subject_id, version, start_ms, end_ms, segment_status, source_sha256. A
    changed interval counts the version up, drops the clip and leaves a record of both
    states; an equal one changes nothing. One payload a recording is expected at a time.
    """
    own = q.select("subject_id", "exam_id", F.col("number").alias("own_number"), "section")
    rows = payloads.select("subject_id", "version", "start_ms", "end_ms", F.col("segment_status").alias("new_status"), "source_sha256").join(own, "subject_id")
    rows = rows.join(assets.select("exam_id", "duration_seconds", F.col("source_sha256").alias("stored_sha")), "exam_id", "left")
    length = F.col("end_ms") - F.col("start_ms")
    fault = _first({
        "section": F.col("section") != "listening",
        "version": F.coalesce(F.col("version") < 0, F.lit(True)),
        "status": F.coalesce(~F.col("new_status").isin("candidate", "verified"), F.lit(True)),
        "bounds": F.coalesce((F.col("start_ms") < 0) | (length < SHORTEST_MS), F.lit(True)),
        "beyond_source": F.coalesce(F.col("end_ms") > F.bround(F.col("duration_seconds") * 1000), F.lit(True)),
        "too_long": length > LONGEST_MS,
        "source_changed": ~F.col("source_sha256").eqNullSafe(F.col("stored_sha")),
    })
    rows = rows.withColumn("fault", fault).withColumn("number", F.explode(F.when(F.col("section") == "listening", shared_partner(F.col("own_number"))).otherwise(F.array("own_number"))))
    rows = rows.select(F.col("subject_id").alias("payload_id"), "exam_id", "number", F.col("version").alias("seen"), F.col("start_ms").alias("new_start"), F.col("end_ms").alias("new_end"), "new_status", "fault")
    rows = rows.join(q.select("exam_id", "number", "subject_id"), ["exam_id", "number"]).join(segments.drop("exam_id", "number"), "subject_id", "left")
    pair = Window.partitionBy("payload_id")
    conflict = F.bool_or(F.coalesce("version", F.lit(0)) != F.col("seen")).over(pair)
    unsaved = F.bool_or(F.col("version").isNull()).over(pair) & (F.col("new_status") == "verified")
    same = F.coalesce((F.col("start_ms") == F.col("new_start")) & (F.col("end_ms") == F.col("new_end")) & (F.col("segment_status") == F.col("new_status")), F.lit(False))
    rows = rows.withColumn("outcome", F.when(F.col("fault").isNotNull(), "invalid").when(conflict, "conflict").when(unsaved, "not_previewed").when(same, "unchanged").otherwise("saved"))
    saved = F.col("outcome") == "saved"
    pick = lambda new, old: F.when(saved, F.col(new)).otherwise(F.col(old))
    version = F.when(saved, F.coalesce(F.col("version") + 1, F.lit(1))).otherwise(F.col("version"))
    state = lambda *names: F.struct(*[F.col(n).alias(a) for a, n in zip(("end_ms", "start_ms", "status"), names)])
    before = F.when(F.col("version").isNotNull(), state("end_ms", "start_ms", "segment_status"))
    record = to_json(F.struct(state("new_end", "new_start", "new_status").alias("after"), before.alias("before")))
    rows = rows.withColumn("evidence", F.when(saved, record))
    return rows.select("payload_id", "subject_id", "outcome", "fault", pick("new_start", "start_ms").alias("start_ms"), pick("new_end", "end_ms").alias("end_ms"), pick("new_status", "segment_status").alias("segment_status"), version.alias("version"), F.when(~saved, F.col("clip")).alias("clip"), "evidence")


def clip_identity(segments: DataFrame) -> DataFrame:
    """Recordings whose questions do not agree in their interval, version and clip."""
    rows = segments.withColumn("first", F.array_min(shared_partner(F.col("number"))))
    state = F.struct("start_ms", "end_ms", "segment_status", "version", "clip")
    return rows.groupBy("exam_id", "first").agg(F.count(F.lit(1)).alias("questions"), F.count_distinct(state).alias("states")).where("states > 1")


def register_candidates(proposals: DataFrame, q: DataFrame, segments: DataFrame, assets: DataFrame) -> DataFrame:
    """One row for each question of the proposed intervals; existing rows stay, and other sources are refused.

    ``proposals``: exam_id, questions (array of numbers), start_ms, end_ms, source_sha256.
    """
    rows = proposals.select("exam_id", F.explode("questions").alias("number"), "start_ms", "end_ms", "source_sha256")
    rows = rows.join(q.select("exam_id", "number", "subject_id"), ["exam_id", "number"]).join(assets.select("exam_id", F.col("source_sha256").alias("stored")), "exam_id", "left")
    rows = rows.join(segments.select("subject_id", F.col("start_ms").alias("old_start")), "subject_id", "left")
    status = F.when(~F.col("source_sha256").eqNullSafe(F.col("stored")), "stale_source").when(F.col("old_start").isNotNull(), "kept").otherwise("registered")
    return rows.select("subject_id", status.alias("action"), F.when(status != "stale_source", F.coalesce("old_start", "start_ms")).alias("start_ms"))


def relink_images(links: DataFrame, renames: DataFrame) -> DataFrame:
    """Image links with old keys replaced; ``renames``: old_key, new_key."""
    return links.join(renames.withColumnRenamed("old_key", "image_key"), "image_key", "left").select("subject_id", F.coalesce("new_key", "image_key").alias("image_key")).distinct()


def _count(x: Column) -> Column:
    """A whole number of 0 or more, else null."""
    n = F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))
    return F.when(n >= 0, n)


def normal_counts(summary: Column, names: tuple[str, ...]) -> list[Column]:
    """``total`` and the named counts of a summary document, at its top or under ``totals``."""
    zero = F.lit(0).cast("long")
    at = lambda path: F.try_variant_get(summary, path, "variant")
    each = [F.coalesce(F.when(at(f"$.{n}").isNotNull(), _count(at(f"$.{n}"))).otherwise(_count(at(f"$.totals.{n}"))), zero) for n in names]
    total = F.coalesce(_count(at("$.total")), sum(each[1:], each[0]))
    return [total.alias("total"), *[c.alias(n) for c, n in zip(each, names)]]
