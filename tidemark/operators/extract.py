"""Parsers of answer tables and transcripts, their checks, and corrections of extracted text.

Pages arrive as text; decoding them is an adapter. Every parser fails closed: rows of a
document with a fault are not returned, and the fault is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import SPEAKERS, between_marks, dialogue, plain_digits, space_punctuation, space_speakers
from tidemark.operators.bundle import SHARED

#: What stands before and after an answer table, and what names its section.
TABLE_START, TABLE_END = "배점", "답지"
SECTION_MARKS = {"listening": "듣기", "reading": "읽기"}
CHOICE_MARK = "①"
NUMBER = "([1-9]|[12][0-9]|30)\\.\\s*"
VISUAL = "Word spacing was extracted by another parser; a person must still compare text and recording"


def answer_tables(pages: DataFrame, expected: dict[str, int], total: int) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of answer tables. ``pages``: doc, section, page, text.

    A table is triples of number, choice and points between two marks; numbers are 1 to n
    once each, choices 1 to 4, points 2 to 4, and the points of a section have one total.
    """
    count = F.create_map(*[x for s, n in expected.items() for x in (F.lit(s), F.lit(n))])
    marks = F.create_map(*[x for s, m in SECTION_MARKS.items() for x in (F.lit(s), F.lit(m))])
    inside = between_marks(F.col("text"), TABLE_START, TABLE_END)
    cells = F.filter(F.split(inside, "(?U)\\s+"), lambda x: x != "")
    rows = pages.withColumns({"n": count[F.col("section")], "cells": cells, "marked": F.col("text").contains(marks[F.col("section")])})
    triple = lambda k: F.struct(*[c.alias(a) for a, c in zip(("number", "choice", "points"), (F.get("cells", k * 3), plain_digits(F.get("cells", k * 3 + 1)), F.get("cells", k * 3 + 2)))])
    whole = F.size("cells") == F.col("n") * 3
    rows = rows.withColumn("t", F.when(whole, F.transform(F.sequence(F.lit(0), F.col("n") - 1), triple)))
    number, points = (lambda x: x["number"].try_cast("int")), (lambda x: x["points"].try_cast("int"))
    sound = lambda x: F.coalesce(number(x).between(1, F.col("n")) & x["choice"].isin("1", "2", "3", "4") & points(x).isin(2, 3, 4), F.lit(False))
    numbers = F.transform("t", number)
    fault = (
        F.when(~F.coalesce("marked", F.lit(False)), "section_mark").when(F.col("cells").isNull(), "table_marks").when(F.col("t").isNull(), "cells").when(~F.forall("t", sound), "row")
        .when(F.size(F.array_distinct(numbers)) < F.col("n"), "duplicate").when(~F.array_sort(numbers).eqNullSafe(F.sequence(F.lit(1), F.col("n"))), "numbering")
        .when(F.aggregate(F.transform("t", points), F.lit(0), lambda a, x: a + x) != total, "total")
    )
    rows = rows.withColumn("fault", fault)
    good = rows.where("fault is null").select("doc", "section", "page", F.explode("t").alias("x")).select("doc", "section", "page", *[F.col(f"x.{c}").cast("int").alias(c) for c in ("number", "choice", "points")])
    return good, rows.where("fault is not null").select("doc", "section", "fault")


def reconcile(preview: DataFrame, answers: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """Questions of a preview with everything in which they differ from the answer table or from the rules.

    ``preview``: doc, id, section, number, answer, points, level, page, printed_page,
    options, images, requires_image, source_sha256 and expected_sha256. The table counts
    within the section, so the section's offset is taken off.
    """
    offset = F.create_map(*[x for s, n in offsets.items() for x in (F.lit(s), F.lit(n))])
    local = F.col("number") - offset[F.col("section")]
    rows = preview.withColumn("local", local).join(answers.select("doc", "section", F.col("number").alias("local"), "choice", F.col("points").alias("table_points")), ["doc", "section", "local"], "left")
    text = F.exists("options", lambda x: F.coalesce(x != "", F.lit(False)))
    faults = {
        "missing_answer": F.col("choice").isNull(),
        "answer": F.col("answer") != F.col("choice"),
        "points": F.col("points") != F.col("table_points"),
        "level": ~F.col("level").eqNullSafe("I"),
        "source": ~F.col("source_sha256").eqNullSafe(F.col("expected_sha256")),
        "page": F.coalesce(F.col("page") != F.col("printed_page") + 2, F.lit(True)),
        "options": F.coalesce(F.size("options") != 4, F.lit(True)),
        "no_choices": (F.size("images") == 0) & ~text,
        "image_flag": F.col("requires_image") != (F.size("images") > 0),
    }
    broken = F.filter(F.array(*[F.when(bad, name) for name, bad in faults.items()]), lambda x: x.isNotNull())
    return rows.select("doc", "id", "section", "number", broken.alias("faults"))


def coverage_faults(questions: DataFrame, expected: dict[str, tuple[int, int]]) -> DataFrame:
    """Per document, numbers that are missing, repeated or not expected; ``expected`` has the range of each section."""
    ranges = F.array(*[F.struct(F.lit(s).alias("section"), F.sequence(F.lit(a), F.lit(b)).alias("numbers")) for s, (a, b) in expected.items()])
    want = questions.select("doc").distinct().select("doc", F.explode(ranges).alias("r")).select("doc", "r.section", F.explode("r.numbers").alias("number"))
    have = questions.groupBy("doc", "section", "number").agg(F.count(F.lit(1)).alias("n"))
    rows = want.withColumn("wanted", F.lit(True)).join(have, ["doc", "section", "number"], "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return rows.withColumn("fault", fault).where("fault is not null").select("doc", "section", "number", "fault")


def transcripts(pages: DataFrame, speakers: tuple[str, ...] = SPEAKERS) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of transcripts. ``pages``: doc, page, text, and other, the same page by a second parser.

    A question runs from its number to the next one, and its dialogue ends before the first
    choice. Where a page begins with the first of two questions on one recording, the
    dialogue stands before it and both get it. The parsers must agree but for white space.
    """
    bare = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
    agree = bare(F.col("text")) == bare(F.col("other"))
    parts = F.split(F.concat(F.lit("\n"), "text"), f"(?m)(?=^{NUMBER})")
    rows = pages.select("doc", "page", F.coalesce(agree, F.lit(False)).alias("agree"), F.get(parts, F.lit(0)).alias("preamble"), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(0))).alias("p"))
    number = lambda x: F.regexp_extract(x, f"^{NUMBER}", 1).cast("int")
    first = number(F.get("p", F.lit(0)))
    rows = rows.withColumn("first", first).withColumn("passage", F.when(first.isin(*[a for a, _ in SHARED]), dialogue(F.col("preamble"), speakers)))
    one = rows.where("agree").select("doc", "page", "first", "passage", F.explode("p").alias("x")).withColumn("number", number(F.col("x")))
    shared = F.col("passage").isNotNull() & F.col("number").between(F.col("first"), F.col("first") + 1)
    body = F.substring_index(F.regexp_replace("x", f"^{NUMBER}", ""), CHOICE_MARK, 1)
    # a shared passage that is empty falls back on the question's own dialogue
    said = F.when(shared & (F.col("passage") != ""), F.col("passage")).otherwise(dialogue(body, speakers))
    partner = F.when(F.col("number") % 2 == 1, F.col("number") + 1).otherwise(F.col("number") - 1)
    warnings = F.when(shared, F.array(F.lit(VISUAL), F.concat(F.lit("Dialogue shared with question "), partner))).otherwise(F.array(F.lit(VISUAL)))
    one = one.select("doc", "page", "number", space_speakers(said, speakers).alias("dialogue"), warnings.alias("warnings"))
    per = Window.partitionBy("doc", "number")
    one = one.withColumn("copies", F.count(F.lit(1)).over(per))
    faults = (
        rows.where("not agree").select("doc", "page", F.lit(None).cast("int").alias("number"), F.lit("parsers_disagree").alias("fault"))
        .unionByName(rows.where("agree and passage = ''").select("doc", "page", F.col("first").alias("number"), F.lit("shared_missing").alias("fault")))
        .unionByName(one.where("dialogue = ''").select("doc", "page", "number", F.lit("dialogue_missing").alias("fault")))
        .unionByName(one.where("copies > 1").select("doc", "page", "number", F.lit("duplicate").alias("fault")))
    )
    return one.drop("copies"), faults


def corrections(texts: DataFrame, before: str = "\\p{L}", after: str = "\\p{L}") -> DataFrame:
    """Fields whose punctuation lacks a space. ``texts``: id, field, text; returns id, field, before, after, spaces."""
    new = space_punctuation(F.col("text"), before, after)
    rows = texts.select("id", "field", F.col("text").alias("before"), new.alias("after")).where("before <> after")
    return rows.withColumn("spaces", F.length("after") - F.length("before"))


def change_maps(changes: DataFrame) -> DataFrame:
    """Per id, a JSON map from field to the text before and after, and the spaces that were put in."""
    changes = changes.groupBy("id", "field").agg(F.min(F.struct("after", "before")).alias("c"), F.sum("spaces").alias("spaces"))  # a field that repeats counts once
    item = F.struct(F.col("field").alias("key"), F.col("c").alias("value"))
    rows = changes.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("c"), F.sum("spaces").alias("spaces"), F.count(F.lit(1)).alias("fields"))
    return rows.select("id", "fields", "spaces", F.to_json(F.map_from_entries("c")).alias("changes"))


def extent_gate(changes: DataFrame, expected: DataFrame) -> DataFrame:
    """Per group of fields, whether the number of spaces is exactly the approved one; ``expected``: field, spaces."""
    got = changes.groupBy("field").agg(F.sum("spaces").alias("got"))
    rows = expected.withColumnRenamed("spaces", "wanted").join(got, "field", "full")
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"wanted": F.coalesce("wanted", zero), "got": F.coalesce("got", zero)})
    return rows.withColumn("ok", F.col("wanted") == F.col("got"))


# --- reports over an import ------------------------------------------------------------------


def pilot_report(q, choices, answers, transcripts_, images, segments) -> DataFrame:
    """Per exam, the counts of an import report; the list of questions with pictures is in their order."""
    own = q.select("subject_id", "exam_id")
    count = lambda df, name, cond=None: own.join(df, "subject_id").groupBy("exam_id").agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name))
    base = q.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("questions"), *[F.count_if(F.col("section") == s).alias(s) for s in ("listening", "reading")], *[F.count_if(F.col("status") == s).alias(s) for s in ("needs_manual_review", "verified", "rejected")],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("requires_image"), F.col("number")))).cast("array<string>"), ",").alias("image_required_questions"),
    )
    linked = own.join(images, "subject_id").groupBy("exam_id").agg(F.count(F.lit(1)).alias("image_links"), F.count_distinct("image_key").alias("active_images"))
    seg = own.join(segments.drop("exam_id"), "subject_id").groupBy("exam_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("segment_status") == "verified").alias("verified_segments"), F.count_if((F.col("segment_status") == "verified") & F.col("clip").isNotNull()).alias("exported_segments"))
    out = base
    for part in (count(choices, "choices"), count(answers, "answers_agree", F.col("agree")), count(transcripts_, "transcripts"), linked, seg):
        out = out.join(part, "exam_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("choices", "answers_agree", "transcripts", "image_links", "active_images", "segments", "verified_segments", "exported_segments")})
    return out.withColumn("manual_review_required", (F.col("needs_manual_review") > 0) | (F.col("rejected") > 0) | (F.col("verified_segments") != F.col("listening")))


def quality_gate(report: DataFrame, q, answers, transcripts_, records, size: int, listening: int) -> DataFrame:
    """(exam_id, check_name, expected, actual, ok) of an import; counts of broken rows must be 0."""
    own = q.select("subject_id", "exam_id", "points", "status")
    invalid = own.join(answers, "subject_id").groupBy("exam_id").agg(F.count_if(~F.col("points").isin(2, 3, 4) | ~F.col("agree")).alias("invalid_points_or_answers"))
    sealed = records.where(F.col("scope") == "manual_question_review").select("subject_id", "status").distinct()
    unsupported = own.where("status in ('verified', 'rejected')").join(sealed, ["subject_id", "status"], "left_anti").groupBy("exam_id").agg(F.count(F.lit(1)).alias("reviewed_without_record"))
    disagree = own.join(transcripts_, "subject_id").groupBy("exam_id").agg(F.count_if(F.col("transcript_status") != F.col("status")).alias("transcript_status_differs"))
    rows = report
    for part in (invalid, unsupported, disagree):
        rows = rows.join(part, "exam_id", "left")
    wanted = {
        "questions": size, "listening": listening, "reading": size - listening, "choices": 4 * size, "answers_agree": size, "transcripts": listening,
        "known_statuses": size, "invalid_points_or_answers": 0, "reviewed_without_record": 0, "transcript_status_differs": 0,
    }
    actual = lambda c: F.col("needs_manual_review") + F.col("verified") + F.col("rejected") if c == "known_statuses" else F.coalesce(F.col(c), F.lit(0).cast("long"))
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.lit(n).cast("long").alias("expected"), actual(c).alias("actual")) for c, n in wanted.items()]))
    return rows.select("exam_id", one.alias("c")).select("exam_id", "c.*", (F.col("c.expected") == F.col("c.actual")).alias("ok"))
