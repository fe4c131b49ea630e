"""Queries of links, parsers, import reports and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import bundle, extract
from tidemark.plans import exam
from tidemark.plans.registry import query, table
from tidemark.sources import links

# --- links -----------------------------------------------------------------------------

#: What the n-th element of an exam's page is: a heading for every tenth, else a link by n % 7.
HEADING_TEXT = ("EXAM I", "Files", "EXAM II papers", "exam 1", "Notes", "EXAM Ⅱ")


def pages(spark, d):
    """A page for each exam: page_id, url, html."""
    q = exam.questions(spark, d)
    n, i = F.col("number"), F.col("subject_id")
    heading = F.element_at(F.array(*[F.lit(x) for x in HEADING_TEXT]), F.expr("(number - 1) div 10 + 1").cast("int"))
    level = F.element_at(F.array(F.lit("h2"), F.lit("h3"), F.lit("h4")), F.expr("(number div 10) % 3 + 1").cast("int"))
    kind = F.expr("number % 7")
    href = F.when(kind == 0, F.concat(F.lit("/f/"), i, F.lit(".PDF?x=1&amp;y"))).when(kind == 1, F.concat(F.lit("get?id="), i)).when(kind == 2, "").when(kind == 3, "mailto:a@e.org").when(kind == 4, F.concat(F.lit("/course/"), i)).when(kind == 5, "/f/same.pdf").otherwise(F.concat(F.lit("/EXAM II/"), i, F.lit(".pdf")))
    label = F.when(kind == 0, F.concat(F.lit("Reading\n  question "), i)).when(kind == 1, "Answer <b>key</b>").when(kind == 3, "test paper").when(kind == 5, F.concat(F.lit("EXAM I 듣기 "), i)).otherwise(F.concat(F.lit("File "), i))
    item = F.when(n % 10 == 1, F.concat(F.lit("<"), level, F.lit("> "), heading, F.lit("</"), level, F.lit(">"))).otherwise(F.concat(F.lit('<a class=x href="'), href, F.lit('">'), label, F.lit("</a>")))
    rows = q.groupBy("exam_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", item.alias("x")))), lambda x: x["x"]), "\n").alias("html"))
    return rows.select(F.col("exam_id").alias("page_id"), F.concat(F.lit("https://e.org/p/"), "exam_id").alias("url"), "html")


PAGES = exam.SQL + """, it AS (SELECT exam_id AS page_id, subject_id AS i, number, number % 7 AS k, CASE WHEN number % 10 = 1 THEN ['I', NULL, 'II', 'I', NULL, NULL][(number - 1) // 10 + 1] END AS h FROM q),
ia AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS hl FROM it),
li AS (SELECT page_id, number, row_number() OVER (PARTITION BY page_id ORDER BY number) AS pos, CASE k WHEN 0 THEN '/f/' || i || '.PDF?x=1&y' WHEN 1 THEN 'get?id=' || i WHEN 3 THEN 'mailto:a@e.org' WHEN 4 THEN '/course/' || i WHEN 5 THEN '/f/same.pdf' ELSE '/EXAM II/' || i || '.pdf' END AS href,
  CASE k WHEN 0 THEN 'Reading question ' || i WHEN 1 THEN 'Answer key' WHEN 3 THEN 'test paper' WHEN 5 THEN 'EXAM I 듣기 ' || i ELSE 'File ' || i END AS label, hl, k FROM ia WHERE number % 10 <> 1 AND k <> 2),
cl AS (SELECT *, CASE k WHEN 1 THEN 'https://e.org/p/' || href WHEN 3 THEN href ELSE 'https://e.org' || href END AS link, CASE WHEN k = 5 THEN 'I' WHEN k = 6 THEN 'II' ELSE coalesce(hl, 'UNKNOWN') END AS level, CASE k WHEN 0 THEN 'QUESTIONS' WHEN 1 THEN 'ANSWER_KEY' ELSE 'UNCLASSIFIED' END AS kind, CASE k WHEN 0 THEN 'READING' WHEN 5 THEN 'LISTENING' ELSE 'COMBINED_OR_UNKNOWN' END AS section FROM li WHERE k IN (0, 1, 5, 6)),
iv AS (SELECT page_id AS session, level, kind, section, label, link AS url, 'https://e.org/p/' || page_id AS source_page, row_number() OVER (PARTITION BY page_id ORDER BY first) AS pos FROM (SELECT *, min(pos) OVER (PARTITION BY page_id, link) AS first, row_number() OVER (PARTITION BY page_id, link ORDER BY pos DESC) AS n FROM cl) WHERE n = 1)
"""


@query("SELECT page_id, pos, href, label, hl AS heading_level FROM li", PAGES)
def link_scan_headings(spark, d):
    return links.link_index(pages(spark, d)).select("page_id", "pos", "href", "label", "heading_level")


@query("SELECT session, level, kind, section, label, url, source_page, 'indexed' AS status, '' AS file, '' AS sha256, '' AS error FROM iv", PAGES)
def link_inventory(spark, d):
    return links.inventory(pages(spark, d), "EXAM").drop("pos")


@query("SELECT page_id, octet_length(encode(html))::BIGINT AS bytes, CASE WHEN octet_length(encode(html)) > 4000 THEN 'page exceeds 4000 bytes' END AS error FROM pages")
def page_fetch_cap(spark, d):
    p = table(spark, d, "pages")
    got = links.fetched(p, 4000)
    return got.select("page_id", "error").join(p.select("page_id", F.octet_length("html").cast("long").alias("bytes")), "page_id")


DOWNLOADS = PAGES + """, big AS (SELECT page_id FROM (SELECT exam_id AS page_id, max(subject_id) AS m FROM q GROUP BY exam_id) WHERE page_id % 6 = 4),
nm AS (SELECT iv.*, printf('%03d/%s/EXAM_%03d_%s_%s_%s_%02d.pdf', session, level, session, level, section, kind, pos) AS name, row_number() OVER (ORDER BY session, pos) AS turn FROM iv WHERE session NOT IN (FROM big)),
dl AS (SELECT *, CASE WHEN turn > 200 THEN 'skipped_limit' WHEN pos % 5 = 1 THEN 'already_present' WHEN pos % 5 = 2 THEN 'file_error' WHEN pos % 7 = 3 THEN 'file_error' ELSE 'saved' END AS status, pos % 5 = 2 AS stale FROM nm)
"""


def _downloads(spark, d):
    """Two hundred files are tried; of those some are there, some are not PDFs, and some responses are broken."""
    p = pages(spark, d).withColumn("html", F.when(F.expr("page_id % 6 <> 4"), F.col("html")))
    listed = links.inventory(p, "EXAM")
    name = F.concat_ws("/", F.format_string("%03d", "session"), "level", T.unique_filename("EXAM", F.col("session"), F.col("level"), F.col("section"), F.col("kind"), F.col("pos")))
    good = listed.where("status = 'indexed'").withColumn("name", name)
    have = good.where("pos % 5 in (1, 2)").select(F.col("name").alias("file"), F.expr("pos % 5 = 1").alias("present_sound"), F.sha2("name", 256).alias("present_sha256"))
    body = F.concat(F.lit("%PDF-1.4 "), "name", F.when(F.expr("pos % 7 = 3"), F.lit(" cut")).otherwise(F.lit(" %%EOF\n")))
    bodies = good.select(F.concat_ws(" ", "session", "url").alias("url"), F.encode(body, "UTF-8").alias("body"))
    keyed = listed.withColumn("url", F.when(F.col("status") == "indexed", F.concat_ws(" ", "session", "url")).otherwise(F.col("url")))
    return p, links.downloads(keyed, "EXAM", 200, have, bodies, T.whole_pdf)


@query("""SELECT session, session || ' ' || url AS url, status, CASE WHEN status IN ('saved', 'already_present') THEN name ELSE '' END AS file, CASE WHEN status = 'saved' THEN sha256('%PDF-1.4 ' || name || ' %%EOF' || chr(10)) WHEN status = 'already_present' THEN sha256(name) ELSE '' END AS sha256, CASE WHEN status <> 'file_error' THEN '' WHEN stale THEN 'existing file is not a PDF' ELSE 'response is not a whole PDF' END AS error FROM dl
UNION ALL SELECT page_id, '', 'page_error', '', '', 'no response' FROM big""", DOWNLOADS)
def download_status(spark, d):
    return _downloads(spark, d)[1].select("session", "url", "status", "file", "sha256", "error")


@query("SELECT (SELECT count(DISTINCT exam_id) FROM q) AS source_count, count(*) AS candidate_count, count(*) FILTER (status = 'saved') AS saved, count(*) FILTER (status = 'already_present') AS already_present, count(*) FILTER (status = 'file_error') + (SELECT count(*) FROM big) AS error_count, (SELECT count(*) FROM big) > 0 AS incomplete FROM dl", DOWNLOADS)
def collection_summary(spark, d):
    p, rows = _downloads(spark, d)
    return links.collection_summary(rows, p.select("page_id"))


# --- parsers ------------------------------------------------------------------------------

EXPECTED, TOTAL = {"listening": 30, "reading": 30}, 90


def _answer_pages(spark, d):
    q = exam.questions(spark, d)
    rows = q.join(exam.answers(q).select("subject_id", "choice_number"), "subject_id")
    v, i = F.expr("exam_id % 7"), F.col("subject_id")
    local = F.when(F.col("section") == "reading", F.col("number") - 30).otherwise(F.col("number"))
    number = F.when((v == 1) & (local == 30), 1).otherwise(local)
    choice = F.when((v == 2) & (local == 1), "5").when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in T.CIRCLED]), F.col("choice_number"))).otherwise(F.col("choice_number").cast("string"))
    points = F.when((v == 5) & (local == 1), F.expr("2 + (subject_id + 1) % 3")).otherwise(F.col("points"))
    rows = rows.where(~((v == 4) & (local == 30))).select("exam_id", "section", local.alias("l"), F.concat_ws(" ", number, choice, points).alias("t"))
    rows = rows.groupBy("exam_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "t"))), lambda x: x["t"]), "\n").alias("t"))
    mark = F.when(v == 6, "?").when(F.col("section") == "reading", extract.SECTION_MARKS["reading"]).otherwise(extract.SECTION_MARKS["listening"])
    end = F.when(v == 3, "").otherwise(F.concat(F.lit("\n"), F.lit(extract.TABLE_END)))
    return rows.select(F.col("exam_id").alias("doc"), "section", F.when(F.col("section") == "reading", 2).otherwise(1).alias("page"), F.concat(mark, F.lit(f" {extract.TABLE_START} 번호 {extract.TABLE_START}\n"), "t", end, F.lit(" 1 2 3")).alias("text"))


ANSWERS = exam.SQL + """, ap AS (SELECT exam_id, section, exam_id % 7 AS v, count(*) AS n FROM q GROUP BY ALL),
af AS (SELECT *, CASE WHEN v = 6 THEN 'section_mark' WHEN v = 3 THEN 'table_marks' WHEN n <> 30 OR v = 4 THEN 'cells' WHEN v = 2 THEN 'row' WHEN v = 1 THEN 'duplicate' WHEN v = 5 THEN 'total' END AS fault FROM ap)
"""


@query("SELECT exam_id AS doc, section, CASE section WHEN 'reading' THEN 2 ELSE 1 END AS page, CASE section WHEN 'reading' THEN number - 30 ELSE number END::INT AS number, choice_number AS choice, points FROM q JOIN an USING (subject_id) JOIN af USING (exam_id, section) WHERE fault IS NULL", ANSWERS)
def answer_table(spark, d):
    return extract.answer_tables(_answer_pages(spark, d), EXPECTED, TOTAL)[0]


@query("SELECT exam_id AS doc, section, fault FROM af WHERE fault IS NOT NULL", ANSWERS)
def answer_table_faults(spark, d):
    return extract.answer_tables(_answer_pages(spark, d), EXPECTED, TOTAL)[1]


@query("""SELECT exam_id AS doc, subject_id AS id, concat_ws(',', CASE WHEN k = 9 THEN 'missing_answer' END, CASE WHEN k = 1 THEN 'answer' END, CASE WHEN k = 2 THEN 'points' END, CASE WHEN k = 3 THEN 'level' END, CASE WHEN k = 4 THEN 'source' END, CASE WHEN k = 5 THEN 'page' END, CASE WHEN k = 6 THEN 'options' END, CASE WHEN k = 7 AND NOT requires_image THEN 'no_choices' END, CASE WHEN k = 8 THEN 'image_flag' END) AS faults
FROM (SELECT *, subject_id % 13 AS k FROM q)""", exam.SQL)
def preview_reconciliation(spark, d):
    """Every question against the answer table; thirteen kinds of previews, nine of them at fault."""
    q = exam.questions(spark, d)
    k, i = F.expr("subject_id % 13"), F.col("subject_id")
    local = F.when(F.col("section") == "reading", F.col("number") - 30).otherwise(F.col("number"))
    rows = q.join(exam.answers(q).select("subject_id", "choice_number"), "subject_id")
    answers = rows.where(k != 9).select(F.col("exam_id").alias("doc"), "section", local.alias("number"), F.col("choice_number").alias("choice"), "points")
    options = F.when(k == 7, F.array_repeat(F.lit(""), 4)).otherwise(F.array_repeat(F.col("stem"), F.when(k == 6, 3).otherwise(4)))
    preview = rows.select(
        F.col("exam_id").alias("doc"), i.alias("id"), "section", "number", (F.col("choice_number") + (k == 1).cast("int")).alias("answer"), (F.col("points") + (k == 2).cast("int")).alias("points"), F.when(k == 3, "II").otherwise("I").alias("level"),
        (F.col("number") + F.when(k == 5, 3).otherwise(2)).alias("page"), F.col("number").alias("printed_page"), options.alias("options"), F.when(F.col("requires_image"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("images"),
        (F.col("requires_image") != (k == 8)).alias("requires_image"), F.when(k == 4, "b").otherwise("a").alias("source_sha256"), F.lit("a").alias("expected_sha256"),
    )
    return extract.reconcile(preview, answers, {"listening": 0, "reading": 30}).select("doc", "id", F.array_join("faults", ",").alias("faults"))


@query("""SELECT exam_id AS doc, section, (number + CASE WHEN unnest = 2 THEN 60 ELSE 0 END)::INT AS number, CASE WHEN unnest = 2 THEN 'unexpected' WHEN subject_id % 50 = 8 THEN 'repeated' ELSE 'missing' END AS fault FROM (SELECT *, unnest(CASE WHEN subject_id % 50 = 9 THEN [1, 2] ELSE [1] END) AS unnest FROM q WHERE subject_id % 50 IN (7, 8, 9))
UNION ALL SELECT e.exam_id, CASE WHEN n <= 30 THEN 'listening' ELSE 'reading' END, n::INT, 'missing' FROM (SELECT DISTINCT exam_id FROM q WHERE subject_id % 50 <> 7) e, range(1, 61) AS r(n) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.exam_id = e.exam_id AND q.number = n)""", exam.SQL)
def question_coverage(spark, d):
    q = exam.questions(spark, d).where("subject_id % 50 <> 7")
    rows = q.select(F.col("exam_id").alias("doc"), "section", (F.col("number") + F.expr("case when subject_id % 50 = 9 then 60 else 0 end")).alias("number"))
    again = q.where("subject_id % 50 = 8").select(F.col("exam_id").alias("doc"), "section", "number")
    return extract.coverage_faults(rows.unionByName(again), {"listening": (1, 30), "reading": (31, 60)})


def _transcript_pages(spark, d):
    q = exam.questions(spark, d).where("section = 'listening'")
    n, e = F.col("number"), F.expr("exam_id % 5")
    page = F.when(n <= 24, F.expr("(number - 1) div 8 + 1")).otherwise(F.expr("(number - 25) div 2 + 4")).cast("int")
    spoken = F.when((e == 4) & (n == 10), "").otherwise(F.concat(F.lit("남자:  "), "stem", F.lit("?네\n \n여자 : ok "), n, F.lit("\n")))
    item = F.concat(n, F.lit(". 다음을 들으십시오 12. "), "stem", F.lit("\n"), F.when(n <= 24, spoken).otherwise(""), F.lit("① a\n② b 남자: no\n"))
    item = F.when((e == 3) & (n == 5), F.concat(item, item)).otherwise(item)
    rows = q.groupBy("exam_id", page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", item.alias("x")))), lambda x: x["x"]), "").alias("t"))
    head = F.when((F.col("page") >= 4) & ~((e == 2) & (F.col("page") == 4)), F.concat(F.lit("듣기\n남자: shared "), "exam_id", F.lit("\n"))).otherwise("듣기 대본\n")
    text = F.concat(head, "t")
    return rows.select(F.col("exam_id").alias("doc"), "page", text.alias("text"), F.when((e == 1) & (F.col("page") == 2), F.concat(text, F.lit("x"))).otherwise(F.regexp_replace(text, " ", "  ")).alias("other"))


TRANSCRIPTS = exam.SQL + """, tq AS (SELECT exam_id AS doc, number, stem, exam_id % 5 AS e, CASE WHEN number <= 24 THEN (number - 1) // 8 + 1 ELSE (number - 25) // 2 + 4 END::INT AS page FROM q WHERE section = 'listening'),
td AS (SELECT *, CASE WHEN e = 4 AND number = 10 OR e = 2 AND page = 4 THEN '' WHEN number <= 24 THEN '남자: ' || stem || '? 네' || chr(10) || '여자: ok ' || number ELSE '남자: shared ' || doc END AS dialogue FROM tq WHERE NOT (e = 1 AND page = 2))
"""


@query(f"""SELECT doc, page, number, dialogue, CASE WHEN number >= 25 THEN '{extract.VISUAL}|Dialogue shared with question ' || CASE WHEN number % 2 = 1 THEN number + 1 ELSE number - 1 END ELSE '{extract.VISUAL}' END AS warnings FROM td UNION ALL SELECT doc, page, number, dialogue, '{extract.VISUAL}' FROM td WHERE e = 3 AND number = 5""", TRANSCRIPTS)
def transcript_extraction(spark, d):
    rows = extract.transcripts(_transcript_pages(spark, d))[0]
    return rows.select("doc", "page", "number", "dialogue", F.array_join("warnings", "|").alias("warnings"))


@query("""SELECT DISTINCT doc, page, NULL::INT AS number, 'parsers_disagree' AS fault FROM tq WHERE e = 1 AND page = 2 UNION ALL SELECT doc, page, number, 'shared_missing' FROM td WHERE e = 2 AND number = 25
UNION ALL SELECT doc, page, number, 'dialogue_missing' FROM td WHERE dialogue = '' UNION ALL SELECT doc, page, number, 'duplicate' FROM td, range(2) WHERE e = 3 AND number = 5""", TRANSCRIPTS)
def transcript_faults(spark, d):
    return extract.transcripts(_transcript_pages(spark, d))[1]


# --- reports and corrections ---------------------------------------------------------------

REPORT = exam.SQL + """, rp AS (SELECT exam_id, count(*) AS questions, count(*) FILTER (section = 'listening') AS listening, count(*) FILTER (section = 'reading') AS reading, count(*) FILTER (status = 'needs_manual_review') AS needs_manual_review, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected,
  coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (requires_image), '') AS image_required_questions, count(*) * 4 AS choices, count(*) FILTER (nation <> 3) AS answers_agree, count(*) FILTER (section = 'listening') AS transcripts FROM q GROUP BY exam_id),
ri AS (SELECT exam_id, count(*) AS image_links, count(DISTINCT image_key) AS active_images FROM q JOIN im USING (subject_id) GROUP BY exam_id), rg AS (SELECT exam_id, count(*) AS segments, count(*) FILTER (segment_status = 'verified') AS verified_segments, count(clip) FILTER (segment_status = 'verified') AS exported_segments FROM seg GROUP BY exam_id)
"""


def _report(spark, d):
    q = exam.questions(spark, d)
    return q, extract.pilot_report(q, exam.choices(q), exam.answers(q), exam.transcripts(q), exam.images(q), exam.segments(q))


@query("""SELECT rp.*, coalesce(image_links, 0) AS image_links, coalesce(active_images, 0) AS active_images, coalesce(segments, 0) AS segments, coalesce(verified_segments, 0) AS verified_segments, coalesce(exported_segments, 0) AS exported_segments, needs_manual_review > 0 OR rejected > 0 OR coalesce(verified_segments, 0) <> listening AS manual_review_required
FROM rp LEFT JOIN ri USING (exam_id) LEFT JOIN rg USING (exam_id)""", REPORT)
def import_report(spark, d):
    return _report(spark, d)[1]


@query(f"""SELECT exam_id, check_name, expected::BIGINT AS expected, actual, expected = actual AS ok FROM (SELECT rp.*, coalesce(b, 0) AS b, coalesce(u, 0) AS u, coalesce(t, 0) AS t FROM rp LEFT JOIN (SELECT exam_id, count(*) FILTER (nation = 3) AS b, count(*) FILTER (status <> 'needs_manual_review' AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.subject_id = q.subject_id AND rec.status = q.status AND scope = 'manual_question_review')) AS u, count(*) FILTER (section = 'listening' AND nation = 5 AND status <> 'needs_manual_review') AS t FROM q GROUP BY exam_id) USING (exam_id)),
LATERAL (VALUES ('questions', {exam.SIZE}, questions), ('listening', 30, listening), ('reading', 30, reading), ('choices', 240, choices), ('answers_agree', 60, answers_agree), ('transcripts', 30, transcripts), ('known_statuses', 60, needs_manual_review + verified + rejected), ('invalid_points_or_answers', 0, b), ('reviewed_without_record', 0, u), ('transcript_status_differs', 0, t)) AS c(check_name, expected, actual)""", REPORT)
def quality_gate(spark, d):
    q, rows = _report(spark, d)
    return extract.quality_gate(rows, q, exam.answers(q), exam.transcripts(q), exam.records(spark, d), exam.SIZE, exam.LISTENING)


SPACED = r"regexp_replace(regexp_replace(text, '(\pL)([.,])(\pL)', '\1\2 \3', 'g'), '(\pL)([.,])(\pL)', '\1\2 \3', 'g')"


def _texts(spark, d, field):
    """Turns that lost the space after their full stops."""
    return table(spark, d, "conversations").where("text is not null and turn is not null").select(F.col("conv_id").alias("id"), field.alias("field"), F.replace(F.col("text"), F.lit(". "), F.lit(".")).alias("text"))


@query(f"""SELECT id, count(*) AS fields, sum(length(a) - length(text))::BIGINT AS spaces, sha256('{{' || string_agg('"' || f || '":{{"after":' || to_json(a) || ',"before":' || to_json(text) || '}}', ',' ORDER BY f) || '}}') AS changes FROM (SELECT conv_id AS id, 't' || turn AS f, text, {SPACED} AS a FROM (SELECT * REPLACE (replace(text, '. ', '.') AS text) FROM conversations) WHERE text IS NOT NULL AND turn IS NOT NULL) WHERE a <> text GROUP BY id""")
def correction_changes(spark, d):
    rows = extract.change_maps(extract.corrections(_texts(spark, d, F.concat(F.lit("t"), "turn"))))
    return rows.select("id", "fields", F.col("spaces").cast("long").alias("spaces"), F.sha2("changes", 256).alias("changes"))


@query(f"SELECT role AS field, n + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS wanted, n AS got, role <> 'user' AS ok FROM (SELECT role, sum(length({SPACED}) - length(text))::BIGINT AS n FROM (SELECT * REPLACE (replace(text, '. ', '.') AS text) FROM conversations) WHERE text IS NOT NULL AND turn IS NOT NULL GROUP BY role)")
def correction_extent_gate(spark, d):
    """The approved numbers are counted by another rule, and one is one too many."""
    texts = _texts(spark, d, F.col("role"))
    n = F.sum(F.regexp_count("text", F.lit("(?<=\\p{L})[.,](?=\\p{L})"))) + F.when(F.col("field") == "user", 1).otherwise(0)
    return extract.extent_gate(extract.corrections(texts), texts.groupBy("field").agg(n.alias("spaces")))


@query("SELECT number, partners FROM (SELECT DISTINCT number, CASE WHEN number < 25 THEN number::VARCHAR ELSE (25 + 2 * ((number - 25) // 2)) || ',' || (26 + 2 * ((number - 25) // 2)) END AS partners FROM q WHERE section = 'listening')", exam.SQL)
def shared_audio_pairs(spark, d):
    rows = exam.questions(spark, d).where("section = 'listening'").select("number").distinct()
    return rows.select("number", F.array_join(bundle.shared_partner(F.col("number")).cast("array<string>"), ",").alias("partners"))
