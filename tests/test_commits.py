"""Several writers on one table: rebase, conflict, pinned reads, repeats and bases."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sinks.commits import CommitTable, Conflict


@pytest.fixture
def table(spark, tmp_path):
    t = CommitTable(spark, f"file://{tmp_path}/t", "k long, v string", "k")
    assert t.begin().put(spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string")).commit() == 1
    return t


def rows(df):
    return {r.k: (r.v, r["__version"]) for r in df.collect()}


def change(spark, keys, v):
    return spark.createDataFrame([(k, v) for k in keys], "k long, v string")


def test_writers_of_one_version(spark, table):
    """Both of disjoint keys stand, the one that overlaps is refused as a whole."""
    first, apart, overlaps = table.begin(), table.begin(), table.begin()
    assert first.put(change(spark, [1, 2], "b")).commit() == 2
    assert apart.put(change(spark, [5, 30], "c")).delete(change(spark, [7], None).select("k")).commit() == 3
    with pytest.raises(Conflict) as e:
        overlaps.put(change(spark, [0, 2, 30], "d")).commit()
    assert (e.value.version, e.value.keys) == (2, [2])
    got = rows(table.read())
    assert got[1] == ("b", 2) and got[5] == ("c", 3) and got[30] == ("c", 3) and got[0] == ("a", 1) and 7 not in got and len(got) == 20
    assert table.begin().put(change(spark, [0, 2, 30], "d")).commit() == 4


def test_two_threads(spark, table):
    """Of two threads on one version with overlapping keys one conflicts; disjoint ones both stand."""
    for pair, want in (([[1, 2], [2, 3]], 1), ([[4, 5], [6, 8]], 2)):
        transactions = [table.begin() for _ in pair]
        barrier, done, refused = threading.Barrier(2), [], []

        def write(tx, keys):
            tx.put(change(spark, keys, f"t{keys[0]}"))
            barrier.wait()
            try:
                done.append(tx.commit())
            except Conflict as e:
                refused.append(e.keys)

        threads = [threading.Thread(target=write, args=x) for x in zip(transactions, pair)]
        [x.start() for x in threads]
        [x.join() for x in threads]
        assert len(set(done)) == len(done) == want and len(refused) == 2 - want
    got = rows(table.read())
    assert {got[4][0], got[5][0]} == {"t4"} and {got[6][0], got[8][0]} == {"t6"}
    assert [(got[1][0], got[2][0]) == ("t1", "t1"), (got[2][0], got[3][0]) == ("t2", "t2")].count(True) == 1


def test_readers_keep_their_version(spark, table):
    """A reader that began before a commit sees nothing of it, nor of what was staged and refused."""
    reader = table.begin()
    before = reader.read()
    table.begin().put(change(spark, range(20), "z")).commit()
    with pytest.raises(Conflict):
        reader.put(change(spark, [3], "y")).commit()
    assert set(rows(before).values()) == {("a", 1)} == set(rows(table.read(1)).values())
    assert set(rows(table.read()).values()) == {("z", 2)}


def test_repeated_commit_changes_nothing(spark, table):
    first = table.begin().put(change(spark, [1], "b")).commit("batch-1")
    table.begin().put(change(spark, [1], "c")).commit()
    assert table.begin(1).put(change(spark, [1], "b")).commit("batch-1") == first and table.head() == 3
    assert rows(table.read())[1] == ("c", 3)


def test_decisions_on_keys_read(spark, table):
    """Two writers that each read what the other writes: the second is refused if it says so."""
    keys = lambda *k: change(spark, k, None).select("k")
    a, b = table.begin(), table.begin()
    a.put(change(spark, [1], "b")).commit(read_keys=keys(2))
    with pytest.raises(Conflict):
        b.put(change(spark, [2], "c")).commit(read_keys=keys(1))
    assert rows(table.read())[2] == ("a", 1)


def test_base(spark, table):
    table.begin().delete(change(spark, [0], None).select("k")).commit()
    late = table.begin()
    assert table.compact() == 3
    assert late.put(change(spark, [5], "b")).commit() == 4
    got = rows(table.read())
    assert len(got) == 19 and got[5] == ("b", 4) and got[1] == ("a", 3) and len(rows(table.read(1))) == 20
    assert len(table._since_base(4)) == 2


def test_refused_changes(spark, table):
    for bad in ([1, 1], [None]):
        with pytest.raises(ValueError):
            table.begin().put(change(spark, bad, "x")).commit()
    assert table.head() == 1
    empty = CommitTable(spark, table.root + "-other", "k long, v string", "k")
    assert empty.head() == 0 and empty.read().count() == 0
    assert empty.begin().put(change(spark, [], "x")).commit() == 1 and empty.read().count() == 0


def test_one_of_many_gets_a_name(spark, table):
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append((table.files.put_if_absent(f"{table.root}/log/x", str(i)), str(i)))) for i in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    winner = [i for ok, i in got if ok]
    assert len(winner) == 1 and table.files.read(f"{table.root}/log/x") == winner[0]
