from pyspark.sql import functions as F

from tidemark.operators import expect, intervals, mutate


def pauses(spark, change=None):
    at, rows = 0, []
    for i in range(31):
        rows.append([at, at + 10000])
        w = 1000 if i + 1 in (26, 28, 30) else 70000 if i + 1 in (25, 27, 29) else 20000
        at += 10000 + w
    if change:
        change(rows)
    p = spark.createDataFrame([("k", int(a), int(b)) for a, b in rows], "k string, start_ms long, end_ms long")
    d = spark.createDataFrame([("k", 5_000_000, "sha")], "k string, duration_ms long, source_sha256 string")
    return intervals.propose(p, d, "k")


def test_intervals(spark):
    rows = sorted(pauses(spark).collect(), key=lambda r: r.questions)
    assert len(rows) == 27
    assert [r.questions for r in rows[-3:]] == [[25, 26], [27, 28], [29, 30]]
    assert sorted(q for r in rows for q in r.questions) == list(range(1, 31))
    assert rows[0].start_ms == 10000 - 150 and rows[0].end_ms == 30000 + 150


def test_intervals_are_all_or_nothing(spark):
    assert pauses(spark, lambda r: r.pop()).isEmpty()
    assert pauses(spark, lambda r: r[3].__setitem__(1, r[4][0] + 5)).isEmpty()
    assert pauses(spark, lambda r: [x.__setitem__(slice(None), [x[0] + 5000, x[1] + 5000]) for x in r[26:]]).isEmpty()


def test_stability(spark):
    rows = [(t, i * 100 + (200 if t == "b" and i == 2 else 0), i * 100 + 50) for t in "ab" for i in range(3)]
    df = spark.createDataFrame([("x", *r) for r in rows] + [("y", t, 1, 2) for t in "ab"], "k string, threshold string, start_ms long, end_ms long")
    assert {r.k: r.stable for r in intervals.threshold_stability(df, "k", "a", count=None).collect()} == {"x": False, "y": True}


def test_digest_ignores_order_and_counts_copies(spark):
    a = spark.createDataFrame([(1, "a|b"), (2, None), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "a|b"), (2, None)], "i int, s string")
    c = spark.createDataFrame([(2, None), (1, "a|b")], "i int, s string")
    d = [expect.table_digest(x, ["i", "s"]).first() for x in (a, b, c)]
    assert d[0] == d[1] and d[0].digest != d[2].digest and d[0].n_rows == 3


def test_expectations(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "k int, v int")
    assert [r.k for r in expect.pk_violations(df, "k").collect()] == [1]
    assert [r.v for r in expect.check_violations(df, {"positive": F.col("v") > 0}).collect()] == [-1]
    other = spark.createDataFrame([(5,)], "id int")
    assert [r.v for r in expect.fk_violations(df, "v", other, "id").collect()] == [-1]
    s = {r.check_name: r.ok for r in expect.suite(df, {"n": (F.count(F.lit(1)), 3), "m": (F.max("v"), 9)}).collect()}
    assert s == {"n": True, "m": False}


def test_mutations(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 4)], "k string, v string, version long")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "n")], "k string, v string")
    assert {r.k: (r.v, r.version) for r in mutate.upsert_versioned(old, new, "k", "v").collect()} == {"a": ("x", 1), "b": ("z", 5), "c": ("n", 1)}
    assert {r.k: r.status for r in mutate.insert_ignore(old, new, "k", "v").collect()} == {"a": "already_imported", "b": "conflict", "c": "inserted"}
    rows = spark.createDataFrame([(1, "verified", "t", "t", "n"), (2, "pending", "t", "u", "n"), (3, "pending", "t", "t", "n"), (4, "pending", "n", "n", "n"), (5, "pending", "t", "t", "n")], "k int, status string, text string, baseline string, new string")
    human = spark.createDataFrame([(5,)], "k int")
    assert {r.k: r.action for r in mutate.upgrade_triage(rows, human, "k").collect()} == {1: "reviewed", 2: "edited", 3: "update", 4: "unchanged", 5: "reviewed"}
    cp = spark.createDataFrame([("p", 1, ["a"]), ("p", 2, ["a", "b"]), ("p", 3, ["b"])], "k string, seq int, ids array<string>")
    assert [(r.seq, r.lost) for r in mutate.monotone_violations(cp, "k", "seq", "ids").collect()] == [(3, 1)]


def test_stream_ignores_repeated_results(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    from tidemark.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"pass_id": "p", "raw": "x"}\n{"pass_id": "p", "raw": "x"}\n{"pass_id": "q", "raw": "y"}\n')
    schema = StructType([StructField("pass_id", StringType()), StructField("raw", StringType())])
    rows = ingest.read_results(spark, str(tmp_path / "in"), schema)
    ingest.append_once(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
