"""Sinks that refuse to overwrite, SQL marks, and small scalar rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonx, sqltext
from tidemark.functions import text as T
from tidemark.sinks import files as sinks
from tidemark.sources import files


def test_marks_outside_of_strings_only():
    assert sqltext.named_marks("a=? AND b='it''s ?' AND \"c?\"=? -- ?\n/* ? */ AND d=?") == ("a=:p1 AND b='it''s ?' AND \"c?\"=:p2 -- ?\n/* ? */ AND d=:p3", 3)
    with pytest.raises(ValueError):
        sqltext.run(None, "SELECT ?")


def test_refused_load_shows_nothing(spark, tmp_path):
    one = spark.createDataFrame([(1,), (None,)], "x int")
    root = f"file://{tmp_path}/load"
    rows = sinks.load_all({"t": one}, root, {"t": [F.col("x") > 0]}).collect()
    assert [(r.rows, r.violations, r.status) for r in rows] == [(2, 1, "refused")] and sinks.loaded(spark, root, "t") is None
    with pytest.raises(ValueError):
        sinks.load_all({"t": one}, root, {})
    assert sinks.publish(one, f"{root}/p") == "published" and sinks.publish(one, f"{root}/p") == "exists"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', ""), (2, "é", "x")], "session int, label string, note string")
    path = f"file://{tmp_path}/csv"
    sinks.write_csv(df, path)
    back = files.read_csv(spark, path, "session int, label string, note string").orderBy("session").collect()
    assert [(r.session, r.label, r.note or "") for r in back] == [(1, 'a "b", c\nd', ""), (2, "é", "x")]
    first = next(tmp_path.glob("csv/*.csv")).read_bytes()
    assert first.startswith(b"\xef\xbb\xbfsession,label,note")


def test_small_rules(spark):
    rows = spark.createDataFrame([("a/b.pdf",), ("/a",), ("a/../b",), ("a\\b",), ("C:/a",), ("a//b",), ("media/x",)], "p string").select("p", T.safe_path(F.col("p")).alias("s"), T.without_root(F.col("p"), "media").alias("w")).collect()
    assert [r.s for r in rows] == [True, False, False, False, False, False, True] and rows[-1].w == "x"
    assert jsonx.pretty({"a": "é"}, "ascii") == '{\n  "a": "\\u00e9"\n}' and "é" in jsonx.pretty({"a": "é"})
    row = spark.range(1).select(T.utc_seconds(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("t"), T.duration_ms(F.lit("Duration: 01:02:03.5")).alias("d"), T.duration_ms(F.lit("none")).alias("n")).first()
    assert (row.t, row.d, row.n) == ("2024-05-06T07:08:09+00:00", 3723500, None)
