"""Digests that add up, hash trees, the log that proves its appends, and numbers in hot groups."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import expect, multiset, mutate, numbering, review
from tidemark.sinks.appendlog import NONE, AppendLog, plus


def _tree(spark, df, path, depth):
    multiset.write_tree(df, "k", ["k", "v"], path, depth)
    return path


def test_parity_reads_only_leaves_that_differ(spark, tmp_path):
    left = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    right = left.where("k <> 11").withColumn("v", F.when(F.col("k").isin(5, 6000), -1).otherwise(F.col("v"))).union(spark.sql("select -1L, 3L"))
    depth = multiset.depth_for(left.count())
    assert depth == 2
    a, b, c = (_tree(spark, df, f"file://{tmp_path}/{n}", depth) for n, df in (("a", left), ("b", right), ("c", left.repartition(7))))
    leaves = multiset.differing_leaves(spark, a, b, depth)
    assert 0 < leaves.count() <= 4
    got = {(r.k, r.difference) for r in multiset.parity_by_descent(spark, a, b, "k", "bigint", depth).collect()}
    assert got == {(5, "changed"), (6000, "changed"), (11, "only_left"), (-1, "only_right")}
    assert got == {(r.k, r.difference) for r in expect.parity_diff(left, right, "k", ["k", "v"]).collect()}
    assert multiset.parity_by_descent(spark, a, c, "k", "bigint", depth).count() == 0
    root = multiset.read_nodes(spark, a, 0).select("n_rows", *multiset.LANES).first()
    assert tuple(root) == tuple(multiset.multiset_digests(left, ["k", "v"], []).first())


def test_parity_of_repeated_and_null_keys_and_empty_tables(spark, tmp_path):
    kind = "k int, v string"
    left = spark.createDataFrame([(None, "a"), (1, "x"), (1, "x"), (2, None), (3, "y")], kind)
    right = spark.createDataFrame([(None, "b"), (1, "x"), (2, ""), (3, "y")], kind)
    none = spark.createDataFrame([], kind)
    a, b, c = (_tree(spark, df, f"file://{tmp_path}/{n}", 3) for n, df in (("a", left), ("b", right), ("c", none)))
    assert {tuple(r) for r in multiset.parity_by_descent(spark, a, b, "k", "int", 3).collect()} == {(None, "changed"), (1, "changed"), (2, "changed")}
    assert {tuple(r) for r in multiset.parity_by_descent(spark, c, b, "k", "int", 3).collect()} == {(k, "only_right") for k in (None, 1, 2, 3)}
    assert multiset.parity_by_descent(spark, c, c, "k", "int", 3).count() == 0


def test_append_log(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", "x int, y string")
    assert log.read().count() == 0 and log.proof().count() == 0
    one, two = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string"), spark.createDataFrame([(3, "c")], "x int, y string")
    assert log.append(one, "one") and log.append(two, "two") and log.append(one.where("false"), "none")
    assert not log.append(one.orderBy(F.desc("x")), "one")
    with pytest.raises(ValueError):
        log.append(two, "one")
    appends = log.appends()
    assert [a.name for a in appends] == ["one", "two", "none"] and log.broken_links() == [] and log.read().count() == 3
    assert appends[-1].total == plus(plus(NONE, appends[0].digest), appends[1].digest) == log._digest(log.read())
    assert {r.status for r in log.proof().collect()} == {"same"}
    two.withColumn("y", F.lit("d")).write.mode("overwrite").parquet(f"{log.root}/data/folder={appends[1].folder}")
    two.write.mode("append").parquet(f"{log.root}/data/folder={appends[2].folder}")
    one.limit(1).write.mode("overwrite").parquet(f"{log.root}/data/folder={appends[0].folder}")
    assert {r.name: r.status for r in log.proof().collect()} == {"one": "removed", "two": "changed", "none": "repeated"}


def test_two_writers_append_one_after_the_other(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", "x int")
    done = []
    work = [threading.Thread(target=lambda i=i: done.append(log.append(spark.createDataFrame([(i,)], "x int"), f"w{i}"))) for i in range(4)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert done == [True] * 4 and sorted(r.x for r in log.read().collect()) == [0, 1, 2, 3] and log.broken_links() == []


def test_hot_group_is_numbered_in_many_tasks(spark, monkeypatch, request):
    # small cells would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).alias("g"), (F.col("id") * 7919 % 3000).alias("o"))
    plain = numbering.numbered(rows, ["g"], ["o"], "n")
    cells = numbering.numbered(rows, ["g"], [F.desc("o")], "n", hot=100)
    backward = numbering.numbered(rows, ["g"], [F.desc("o")], "n")
    assert sorted(map(repr, cells.collect())) == sorted(map(repr, backward.collect()))
    got = numbering.numbered(rows, ["g"], ["o"], "n", hot=100)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    written = spark.read.parquet(next(p for p in got.inputFiles() if "cells-" in p).rsplit("/", 1)[0])
    most = written.groupBy("g", "__cell").count().agg(F.max("count")).first()[0]
    assert written.where("g = 'hot'").select("__cell").distinct().count() >= 2 and most < 1000
    assert numbering.numbered(rows.where("false"), ["g"], ["o"], "n").count() == 0
    monkeypatch.setattr(numbering.numbered, "__defaults__", (100,))
    old = spark.createDataFrame([("hot", 10)], "g string, n long")
    ids = mutate.allocate_ids(old, rows, "g", "n", ["o"]).where("g = 'hot'").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(ids) == (11, 1010, 1000)


def test_history_of_a_hot_subject(spark):
    records = spark.range(500).select((F.col("id") % 1).alias("subject_id"), "id", F.lit('{"note":"n"}').alias("evidence"), F.lit("t").alias("reviewed_at"), F.lit("s").alias("scope"), F.lit("x").alias("status"))
    got = review.histories(records)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    assert (row.version, len(row.history), row.history[0].note) == (500, 30, "n")


def test_row_hash_escapes_text_alone_and_without_patterns(spark):
    df = spark.createDataFrame([("a|b\\", 1.5, None), ("\\|", -2.0, "n"), ("", 0.0, "|v")], "s string, x double, t string").withColumn("d", F.expr("cast(x as decimal(9,2))"))
    h = expect.row_hash(df, df.columns)
    cells = [F.coalesce(F.concat(F.lit("v"), F.regexp_replace(F.col(c).cast("string"), "([\\\\|])", "\\\\$1")), F.lit("n")) for c in df.columns]
    assert df.where(h != F.sha2(F.concat_ws("|", *cells), 256)).isEmpty()
    plan = df.select(h.alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("replace(") == 4
