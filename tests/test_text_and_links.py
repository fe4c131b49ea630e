import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonx
from tidemark.functions import text as T
from tidemark.operators import extract
from tidemark.sources import links


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,level", [("EXAM II", "II"), ("EXAM I", "I"), ("practice", None), ("exam Ⅱ", None), ("EXAMⅡ", "II"), ("EXAM-I", None), ("the exam 2 paper", "II"), (None, None)])
def test_level(spark, text, level):
    assert one(spark, text, lambda c: T.level_of(c, "EXAM")) == level


@pytest.mark.parametrize(
    "text,kind,section",
    [("READING TEST PAPER", "QUESTIONS", "READING"), ("LISTENING TRANSCRIPT", "TRANSCRIPT", "LISTENING"), ("answer key", "ANSWER_KEY", "COMBINED_OR_UNKNOWN"), ("읽기 듣기 문제지", "QUESTIONS", "READING_LISTENING"), ("x", "UNCLASSIFIED", "COMBINED_OR_UNKNOWN")],
)
def test_kind_and_section(spark, text, kind, section):
    assert one(spark, text, T.file_kind) == kind
    assert one(spark, text, T.file_section) == section


def test_filename(spark):
    row = spark.range(1).select(T.unique_filename("EXAM", F.lit(35), F.lit("II"), F.lit("READING"), F.lit("QUESTIONS"), F.lit(2)).alias("x")).first()
    assert row.x == "EXAM_035_II_READING_QUESTIONS_02.pdf"


@pytest.mark.parametrize("before,after", [("가.나", "가. 나"), ("가,나.다", "가, 나. 다"), ("3.14", "3.14"), ("www.a.com", "www.a.com"), ("가...", "가..."), ("가.나.다.라", "가. 나. 다. 라"), ("", ""), (None, None)])
def test_punctuation_is_idempotent(spark, before, after):
    once = one(spark, before, T.space_punctuation)
    assert once == after and one(spark, once, T.space_punctuation) == after


def test_speakers_and_dialogue(spark):
    assert one(spark, "남자:  네?그래요", T.space_speakers) == "남자: 네? 그래요"
    assert one(spark, "title\n\n  a: hi \n\nb: yo", lambda c: T.dialogue(c, ("a", "b"))) == "a: hi\nb: yo"


def test_white_space_with_no_break_space(spark):
    assert one(spark, " a \t b ", T.collapse).strip() == "a b"
    assert one(spark, "a b c", T.without_space) == "abc"


def test_links(spark):
    html = '<h2>EXAM I papers</h2><a href="/a.pdf">Reading question</a><h3>x</h3><a href="b.pdf">EXAM II answer</a><a href="/course">Course</a><a href="c.pdf">EXAM II\n answer</a><a href="b.pdf">second <b>b</b></a>'
    pages = spark.createDataFrame([(1, "https://e.org/x/", html), (2, None, None)], "page_id long, url string, html string")
    found = links.link_index(pages)
    rows = links.classified(links.candidates(found), "EXAM").orderBy("pos").collect()
    assert [(r.link, r.level, r.kind) for r in rows[:2]] == [("https://e.org/a.pdf", "I", "QUESTIONS"), ("https://e.org/x/b.pdf", "II", "ANSWER_KEY")]
    assert [r.level for r in rows] == ["I", "II", "II", "I"]  # a heading without a level does not end the level before it
    last = links.dedup_last(links.candidates(found)).orderBy("pos").collect()
    assert [(r.pos, r.label) for r in last] == [(1, "Reading question"), (2, "second b"), (4, "EXAM II answer")]


def test_anchor_rules(spark):
    html = '<a href="">none</a><a>none</a><a href="/x.pdf">out<a href="/in.pdf">in</a> rest</a><a href="//[bad">b</a><a href="go?id=1">LISTENING TEXT</a><a href="ftp://e.org/f.pdf">f</a>'
    found = links.link_index(spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string"))
    assert [(r.pos, r.href, r.label) for r in found.orderBy("pos").collect()] == [(1, "/x.pdf", "outin"), (2, "//[bad", "b"), (3, "go?id=1", "LISTENING TEXT"), (4, "ftp://e.org/f.pdf", "f")]
    assert [r.link for r in links.candidates(found).orderBy("pos").collect()] == ["https://e.org/x.pdf", "https://e.org/go?id=1"]


def test_inventory_of_unread_pages(spark):
    pages = spark.createDataFrame([(7, "https://e.org/", "<a href='a.pdf'>EXAM I question</a>" + " " * 50), (8, "https://e.org/b", "x" * 200), (9, "u", None)], "page_id long, url string, html string")
    rows = {r.session: r for r in links.inventory(pages, "EXAM", 100).collect()}
    assert rows[7].status == "indexed" and rows[7].level == "I" and rows[8].status == rows[9].status == "page_error" and rows[8].url == ""
    summary = links.collection_summary(links.inventory(pages, "EXAM", 100), pages).first()
    assert (summary.source_count, summary.candidate_count, summary.error_count, summary.incomplete) == (3, 1, 2, True)


def test_dialogue_edges(spark):
    d = lambda t: one(spark, t, lambda c: T.dialogue(c, ("a", "b")))
    assert d("x\r\na : hi\r\n\t\r\n\u3000go on\u00a0\nb: yo") == "a : hi\ngo on\nb: yo"
    assert d("nobody speaks") == "" and d(None) is None and d("") == ""


def test_canonical_json(spark):
    assert one(spark, '{"b": 1.0, "a": "é"}', jsonx.canonical_json) == '{"a":"é","b":1.0}'
    assert one(spark, "{bad", jsonx.canonical_json) is None
    assert one(spark, '{"a": " Ｘ  ß "}', jsonx.identity_json) == '{"a":"x ss"}'
    df = spark.createDataFrame([("Q1", '{"x": "A  b"}'), ("Q1", '{"x": "a B"}'), ("Q2", '{"x": "a b"}')], "s string, i string")
    a, b, c = [r.f for r in df.select(jsonx.fingerprint(F.col("s"), F.col("i")).alias("f")).collect()]
    assert a == b != c


def test_links_in_sql(spark):
    """The table function of links, beside a table and for every row of it."""
    links.register(spark)
    rows = spark.sql("SELECT id, l.* FROM VALUES (1, '<h2>A <a href=\"x.pdf\">t<a href=\"y\">u</a> v</h3> w</h2><a>n</a><a href=\"\">q</a>'), (2, NULL), (3, '<a href=z>open') AS t(id, html), LATERAL page_links(html, 'https://e.org/d/') l").collect()
    assert [(r.id, r.seq, r.pos, r.href, r.raw, r.link) for r in rows] == [(1, 0, 1, "x.pdf", "tu", "https://e.org/d/x.pdf"), (1, 1, None, None, "A tu v w", None)]


def test_transcripts_keep_all_questions_of_a_page(spark):
    """A page with 1,200 numbers: all are read, and told to be duplicates."""
    text = "\n".join(f"{n % 30 + 1}.\n남자: 말 {n}\n①" for n in range(1200))
    rows, faults = extract.transcripts(spark.createDataFrame([(1, 1, text, text)], "doc int, page int, text string, other string"))
    assert rows.count() == faults.where("fault = 'duplicate'").count() == 1200
