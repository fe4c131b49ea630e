"""Documents under their hash, and loads of tables that refer to each other."""

import pytest
from pyspark.sql import functions as F

from tidemark.sinks import loads
from tidemark.sinks.files import loaded
from tidemark.sinks.store import Collision, DocumentStore

KIND = "exam int, position int, body string"


def test_second_snapshot_adds_what_changed(spark, tmp_path):
    s = DocumentStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, None), (2, 3, "")], KIND)
    assert s.put(one.where("false").select("body")) == 0 and s.stored().count() == 0
    assert s.snapshot(one, "one", "exam", "position") == 3
    two = one.withColumn("body", F.when((F.col("exam") == 1) & (F.col("position") == 2), "B").otherwise(F.col("body")))
    assert s.snapshot(two, "two", "exam", "position") == 1
    assert s.snapshot(one, "one", "exam", "position") == 0
    with pytest.raises(ValueError):
        s.snapshot(two, "one", "exam", "position")
    for name, df in (("one", one), ("two", two)):
        back = s.read(name, "exam int, position int")
        assert back.where("fault is not null").count() == 0
        assert sorted(map(repr, back.select("exam", "position", "body").collect())) == sorted(map(repr, df.collect()))
    ids = {n: {r.exam: (r.n, r.sha256) for r in s.identities(n, "exam int, position int", "exam", "position").collect()} for n in ("one", "two")}
    assert ids["one"][2] == ids["two"][2] and ids["one"][1] != ids["two"][1] and ids["one"][2][0] == 3


def test_store_finds_changed_missing_and_colliding_documents(spark, tmp_path):
    s = DocumentStore(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], KIND)
    s.snapshot(docs, "one", "exam", "position")
    path = f"{s.root}/docs/folder={s._folders()[0]}"
    rows = [tuple(r) for r in s.stored().collect()]
    bad = spark.createDataFrame([(h, n, c, "x") for h, n, c, b in rows if b == "a"], "hash string, size long, check string, body string")
    bad.write.mode("overwrite").parquet(path)
    assert {r.position: r.fault for r in s.read("one", "exam int, position int").collect()} == {1: "changed", 2: "missing"}
    bad.withColumn("check", F.lit("other")).write.mode("overwrite").parquet(path)
    with pytest.raises(Collision):
        s.put(docs.select("body"))


def test_order_of_loads():
    refs = [("c", "x", "b", "y"), ("b", "x", "a", "y"), ("b", "p", "b", "y")]
    assert loads.load_order(["c", "d", "b", "a"], refs) == ["a", "d", "b", "c"]
    with pytest.raises(ValueError, match="cycle: a > c > b > a"):
        loads.load_order(["a", "b", "c"], [*refs, ("a", "z", "c", "z")])


def test_ordered_load(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(1, None), (2, 1), (3, 9), (4, 9)], "k int, a int")
    root, refs = f"file://{tmp_path}", [("b", "a", "a", "k"), ("b", "k", "b", "k")]
    bad = loads.load_ordered({"b": lambda: b, "a": lambda: a}, refs, f"{root}/bad").orderBy("position").collect()
    assert [(r.table, r.rows, r.orphans, r.status) for r in bad] == [("a", 3, 0, "held back"), ("b", 4, 2, "broken reference")]
    assert loaded(spark, f"{root}/bad", "a") is None
    good = loads.load_ordered({"b": lambda: b.where("k < 3"), "a": lambda: a}, refs, f"{root}/good").collect()
    assert {r.status for r in good} == {"loaded"} and loaded(spark, f"{root}/good", "b").count() == 2
    turns = iter((a, a.limit(2)))
    moved = loads.load_ordered({"a": lambda: next(turns)}, [], f"{root}/moved").collect()
    assert [r.status for r in moved] == ["source changed"] and loaded(spark, f"{root}/moved", "a") is None
    with pytest.raises(ValueError):
        loads.load_ordered({"a": lambda: a}, [], f"{root}/good")
    empty = loads.load_ordered({"a": lambda: a.where("false")}, [], f"{root}/empty").first()
    assert (empty.rows, empty.status) == (0, "loaded")
