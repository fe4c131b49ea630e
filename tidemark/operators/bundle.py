"""Nested documents of exams and passes: snapshots, frozen scopes, blind, resume and session bundles.

A document is canonical JSON (sorted keys, no spaces) of one exam or pass, so its SHA-256
is its identity. An exam holds a bounded number of questions, which bounds a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.jsonx import json_string

CONTRACT = "audit-contract-1"
#: Pairs of listening questions that share a recording.
SHARED = ((25, 26), (27, 28), (29, 30))


def to_json(col: Column) -> Column:
    return F.to_json(col, {"ignoreNullFields": "false"})


def list_of(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Per key, the values in the given order."""
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("x")))).alias("l"))
    return got.select(key, F.transform("l", lambda x: x["x"]).alias(name))


def question_documents(q, choices, answers, groups, transcripts, images, assets, segments) -> DataFrame:
    """``exam_id, number, subject_id, section, doc``: each question with all that belongs to it, as JSON."""
    rows = q.withColumn("g", F.expr("(number - 1) div 10"))
    rows = rows.join(list_of(choices, "subject_id", "choice", F.struct(F.col("choice").alias("number"), "text"), "choices"), "subject_id", "left")
    rows = rows.join(answers, "subject_id")
    group = F.struct("first_number", "instruction", "last_number").alias("grp")
    rows = rows.join(groups.select("exam_id", "g", group), ["exam_id", "g"], "left")
    said = F.coalesce(F.from_json("warnings_json", "array<string>"), F.array().cast("array<string>"))
    rows = rows.join(transcripts.select("subject_id", F.struct(F.col("dialogue").alias("text"), said.alias("warnings")).alias("transcript")), "subject_id", "left")
    rows = rows.join(list_of(images, "subject_id", "image_key", F.col("image_key"), "images"), "subject_id", "left")
    timed = segments.join(assets.select("exam_id", "source_sha256"), "exam_id").select("subject_id", F.struct("end_ms", "source_sha256", "start_ms").alias("audio"))
    rows = rows.join(timed, "subject_id", "left")
    doc = F.struct(
        F.struct("choice_number", F.col("answer_page").alias("source_page")).alias("answer"), F.col("audio").alias("audio_candidate"), "choices", F.col("number").alias("exam_number"), F.col("grp").alias("group"),
        F.col("subject_id").alias("id"), F.coalesce("images", F.array().cast("array<string>")).alias("images"), "points", "requires_image", "section", "stem", "transcript",
    )
    return rows.select("exam_id", "number", "subject_id", "section", to_json(doc).alias("doc"))


def snapshots(docs: DataFrame) -> DataFrame:
    """``exam_id, snapshot_json, snapshot_sha256, n_questions`` of the question documents."""
    rows = list_of(docs, "exam_id", "number", F.col("doc"), "d")
    body = F.concat(F.lit('{"exam":{"id":'), F.col("exam_id").cast("string"), F.lit('},"questions":['), F.array_join("d", ","), F.lit("]}"))
    return rows.select("exam_id", body.alias("snapshot_json"), F.sha2(body, 256).alias("snapshot_sha256"), F.size("d").cast("long").alias("n_questions"))


def frozen_runs(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Runs over the requested subjects of each exam, in the exam's order; refused where one is unknown.

    ``requests``: exam_id, subject_id. The content of the scope is the run's snapshot.
    """
    asked = requests.select("exam_id", "subject_id").distinct()
    rows = asked.join(docs, ["exam_id", "subject_id"], "left")
    got = rows.groupBy("exam_id").agg(F.count_if(F.col("doc").isNull()).alias("unknown"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("doc").isNull(), F.col("subject_id")))).cast("array<string>"), ",").alias("unknown_ids"))
    kept = snapshots(rows.where("doc is not null")).select("exam_id", "snapshot_sha256", "n_questions")
    sound = F.col("unknown") == 0
    return got.join(kept, "exam_id", "left").select("exam_id", F.when(sound, "created").otherwise("unknown_subjects").alias("status"), "unknown_ids", F.when(sound, F.coalesce("n_questions", F.lit(0).cast("long"))).alias("subject_count"), F.when(sound, F.col("snapshot_sha256")).alias("snapshot_sha256"))


def blind_bundles(docs: DataFrame, passes: DataFrame, snapshot: DataFrame, alignment: str) -> DataFrame:
    """The input of each pass without any earlier result; its hash leaves out the hash itself.

    ``passes``: exam_id, run_id, pass_number, auditor_id, perspective. Passes of the
    perspective ``alignment`` have listening questions only.
    """
    rows = passes.join(docs, "exam_id").where((F.col("perspective") != alignment) | (F.col("section") == "listening"))
    keys = ["exam_id", "run_id", "pass_number", "auditor_id", "perspective"]
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "subject_id", "doc"))).alias("s")).join(snapshot.select("exam_id", "snapshot_sha256"), "exam_id")
    text = lambda key, value: F.concat(F.lit(f'"{key}":'), json_string(value))
    head = F.concat_ws(",", text("auditor_id", F.col("auditor_id")), F.lit('"blind":true'), text("contract_version", F.lit(CONTRACT)))
    tail = F.concat_ws(
        ",", F.concat(F.lit('"pass_number":'), F.col("pass_number").cast("string")), text("perspective", F.col("perspective")), text("run_id", F.col("run_id")), text("snapshot_sha256", F.col("snapshot_sha256")),
        F.concat(F.lit('"subjects":['), F.array_join(F.transform("s", lambda x: x["doc"]), ","), F.lit("]")),
    )
    sha = F.sha2(F.concat(F.lit("{"), head, F.lit(","), tail, F.lit("}")), 256)
    stored = F.concat(F.lit("{"), head, F.lit(","), text("input_sha256", sha), F.lit(","), tail, F.lit("}"))
    return rows.select(*keys, F.transform("s", lambda x: x["subject_id"]).alias("subjects"), sha.alias("input_sha256"), stored.alias("input_json"))


def bound_inputs(bundles: DataFrame) -> DataFrame:
    """Whether each stored input still has the hash it names, and the hash of its column."""
    body = F.regexp_replace("input_json", '"input_sha256":"[0-9a-f]{64}",', "")
    named = F.get_json_object("input_json", "$.input_sha256")
    return bundles.withColumns({"hash_holds": F.sha2(body, 256) == F.col("input_sha256"), "field_holds": F.coalesce(named == F.col("input_sha256"), F.lit(False))})


def resume_bundles(scopes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The remaining subjects of passes with a checkpoint, in the order of the pass, after the newest one.

    ``scopes``: run_id, pass_number, subjects; ``checkpoints``: run_id, pass_number, sequence, completed.
    """
    newest = checkpoints.groupBy("run_id", "pass_number").agg(F.max("sequence").alias("sequence"), F.max_by("completed", "sequence").alias("completed"))
    left = F.filter("subjects", lambda x: ~F.array_contains("completed", x))
    return scopes.join(newest, ["run_id", "pass_number"]).select("run_id", "pass_number", "sequence", F.array_sort("completed").alias("completed"), left.alias("remaining"))


def append_checkpoints(checkpoints: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next checkpoint of each pass; one that forgets a subject is a conflict.

    ``incoming``: run_id, pass_number, completed. The hash is of pass, sequence and subjects.
    """
    newest = checkpoints.groupBy("run_id", "pass_number").agg(F.max("sequence").alias("last"), F.max_by("completed", "sequence").alias("before"))
    rows = incoming.join(newest, ["run_id", "pass_number"], "left")
    none = F.array().cast("array<bigint>")
    forgotten = F.size(F.array_except(F.coalesce("before", none), "completed")) > 0
    sequence = F.coalesce("last", F.lit(0)) + 1
    said = F.concat(F.lit('{"completed_subject_ids":['), F.array_join(F.array_sort("completed").cast("array<string>"), ","), F.lit('],"pass_id":"'), F.concat_ws("/", "run_id", "pass_number"), F.lit('","sequence":'), sequence.cast("string"), F.lit("}"))
    return rows.select("run_id", "pass_number", F.when(forgotten, "conflict").otherwise("appended").alias("status"), F.when(~forgotten, sequence).cast("long").alias("sequence"), F.when(~forgotten, F.sha2(said, 256)).alias("checkpoint_sha256"))


def merge_resumed(remaining: DataFrame, responses: DataFrame) -> DataFrame:
    """Final answers to resumed passes: accepted only on the newest checkpoint and for exactly what remains.

    ``remaining``: as ``resume_bundles`` gives it; ``responses``: run_id, pass_number,
    resume_sequence, completed_now. The merged result is the checkpoint and then the answer.
    """
    rows = responses.join(remaining, ["run_id", "pass_number"], "left")
    now = F.col("completed_now")
    same = (F.size(F.array_except(now, "remaining")) == 0) & (F.size(F.array_except("remaining", now)) == 0)
    status = (
        F.when(F.col("sequence").isNull(), "no_checkpoint").when(~F.col("resume_sequence").eqNullSafe(F.col("sequence")), "stale")
        .when(F.size(F.array_intersect(now, "completed")) > 0, "overlap").when(~same, "not_the_remaining").otherwise("merged")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("merged", F.when(F.col("status") == "merged", F.concat("completed", F.filter("remaining", lambda x: F.array_contains(now, x)))))


def requested_scope(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Requested subjects with their place in the request, and whether they are known."""
    return requests.join(available.select("subject_id", F.lit(True).alias("__known")).distinct(), "subject_id", "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def string_ids(inputs: DataFrame, key: str) -> DataFrame:
    """The distinct ids of the subjects in stored inputs; entries that are no objects, or have no string id, do not count."""
    items = F.explode(F.try_variant_get(F.try_parse_json("input_json"), "$.subjects", "array<variant>"))
    one = inputs.select(key, items.alias("x"))
    named = F.try_variant_get("x", "$.id", "variant")
    return one.where(F.schema_of_variant(named) == "STRING").select(key, F.try_variant_get("x", "$.id", "string").alias("subject")).distinct()


def shared_partner(number: Column) -> Column:
    """All questions of the recording that a listening question is on."""
    out = F.array(number)
    for pair in SHARED:
        out = F.when(number.isin(*pair), F.array(*[F.lit(n) for n in pair])).otherwise(out)
    return out


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))
