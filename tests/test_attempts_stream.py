"""The stream of attempts: retries, results that end a pass, checkpoints, repeats, replays and bounded state."""

import json
import os
from datetime import datetime, timedelta

import pytest

from test_ingest import GOOD
from tidemark.operators import ingest
from tidemark.streaming import attempts

DAY = datetime(2024, 5, 6)


def response(name, **parts):
    return json.dumps(GOOD | {"pass_id": name} | parts)


@pytest.fixture
def stream(spark, tmp_path):
    passes = spark.createDataFrame([(p, "v", "h", ["Q1", "Q2"]) for p in "abcd"], "pass_id string, contract string, input_sha256 string, subjects array<string>").coalesce(1)

    class Stream:
        root, state = str(tmp_path / "out"), str(tmp_path / "state")

        def send(self, *events):
            rows = [(p, n, DAY + timedelta(minutes=at), kind, raw, code, done) for p, n, at, kind, raw, code, done in events]
            spark.createDataFrame(rows, attempts.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            self.run()

        def run(self):
            attempts.ingest_stream(spark, str(tmp_path / "in"), passes, self.root, self.state, "10 minutes", 3_600_000).awaitTermination()

        def table(self, name, *columns):
            df = attempts.ingested(spark, self.root, name)
            return sorted(tuple(r) for r in df.select(*columns).collect())

        def all(self):
            return {n: sorted(map(repr, attempts.ingested(spark, self.root, n).drop("batch").collect())) for n in (*attempts.COLUMNS, "verdicts", "occurrences")}

    s = Stream()
    s.passes = passes
    return s


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_pass_from_retries_to_its_result(spark, stream):
    sound = response("a")
    stream.send(("a", 1, 0, "timed_out", None, "slow", None), ("a", 3, 2, "response", "{", None, None), ("b", 1, 0, "response", response("b", notes=["x"]), None, None), ("z", 1, 0, "response", "{}", None, None))
    # numbers go on after those of the batch before; the result ends the pass
    stream.send(("a", 4, 3, "response", sound, None, None), ("a", 5, 4, "response", sound, None, None), ("a", 6, 5, "failed", None, "late", None), ("b", 2, 6, "response", response("b", notes=["y"]), None, None))
    got = stream.table("attempts", "pass_id", "attempt_number", "status", "error")
    assert got == [("a", 1, "timed_out", "slow"), ("a", 2, "invalid", "not_an_object"), ("a", 3, "succeeded", None), ("b", 1, "succeeded", None)]
    assert stream.table("refusals", "pass_id", "number", "status") == [("a", 6, "failed"), ("b", 2, "response")]
    rows = spark.createDataFrame([("a", sound), ("b", response("b", notes=["x"]))], "pass_id string, raw string")
    verdicts, found, _ = ingest.ingest(rows, stream.passes)
    columns = ("pass_id", "subject", "verdict", "confidence", "rationale", "position")
    assert stream.table("verdicts", *columns) == sorted(tuple(r) for r in verdicts.select(*columns).collect())
    columns = ("pass_id", "subject", "category", "severity", "summary", "detail", "identity", "fingerprint")
    assert stream.table("occurrences", *columns) == sorted(tuple(r) for r in found.select(*columns).collect())


def test_checkpoints_only_grow(stream):
    stream.send(("c", 1, 0, "checkpoint", None, None, ["Q1"]), ("c", 2, 1, "checkpoint", None, None, ["Q2"]))
    stream.send(("c", 3, 2, "checkpoint", None, None, ["Q1", "Q2"]), ("c", 4, 3, "response", response("c"), None, None), ("c", 5, 4, "checkpoint", None, None, ["Q1", "Q2"]))
    assert stream.table("checkpoints", "pass_id", "sequence") == [("c", 1), ("c", 2)]
    assert stream.table("refusals", "pass_id", "number", "error") == [("c", 2, "checkpoint lost subjects"), ("c", 5, "pass has a result")]


def test_replays_change_nothing(stream):
    """The last batch runs again after its end was not recorded; and all events are sent once more."""
    events = [("a", 1, 0, "failed", None, "x", None), ("a", 2, 1, "response", response("a"), None, None), ("b", 1, 1, "failed", None, "y", None)]
    stream.send(*events)
    before = stream.all()
    last = max((n for n in os.listdir(f"{stream.state}/commits") if n.isdigit()), key=int)
    os.remove(f"{stream.state}/commits/{last}")
    if os.path.exists(f"{stream.state}/commits/.{last}.crc"):
        os.remove(f"{stream.state}/commits/.{last}.crc")
    stream.run()
    assert stream.all() == before
    stream.send(*events)
    assert stream.all() == before


def test_state_ends_behind_the_watermark(stream):
    """An hour after its last event a pass is closed, its state is gone, and late events of it are dropped."""
    stream.send(("a", 1, 0, "failed", None, "x", None), ("b", 1, 0, "response", response("b"), None, None))
    stream.send(("d", 1, 300, "failed", None, "x", None))
    stream.send(("a", 2, 1, "failed", None, "late", None), ("d", 2, 301, "failed", None, "x", None))
    assert stream.table("passes", "pass_id", "status", "attempts") == [("a", "open", 1), ("b", "done", 1)]
    assert [(p, n) for p, n in stream.table("attempts", "pass_id", "attempt_number")] == [("a", 1), ("b", 1), ("d", 1), ("d", 2)]


def test_repeats_are_dropped_before_they_are_validated_and_passes_share_a_state(spark, stream, tmp_path):
    def run():
        query = attempts.ingest_stream(spark, str(tmp_path / "in"), stream.passes, stream.root, stream.state, "10 minutes", 3_600_000, buckets=1)
        query.awaitTermination()
        return [{o["operatorName"]: o for o in json.loads(p.json)["stateOperators"]} for p in query.recentProgress]

    events = [(p, 2, 1, "response", response(p), None, None) for p in "abcd"]
    spark.createDataFrame([(p, n, DAY + timedelta(minutes=at), *rest) for p, n, at, *rest in events], attempts.EVENT).write.parquet(str(tmp_path / "in"))
    assert run()[0]["transformWithStateInPySparkExec"]["numRowsTotal"] < 4
    spark.createDataFrame([(p, n, DAY + timedelta(minutes=at), *rest) for p, n, at, *rest in [*events, ("a", 3, 2, "failed", None, "late", None)]], attempts.EVENT).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()[0]["dedupeWithinWatermark"]["customMetrics"]["numDroppedDuplicateRows"] == 4
    assert stream.table("attempts", "pass_id", "attempt_number", "status") == [(p, 1, "succeeded") for p in "abcd"]
    assert stream.table("refusals", "pass_id", "number") == [("a", 3)]


def test_passes_of_one_bucket_end_each_at_its_time(spark, stream, tmp_path):
    def send(*events):
        rows = [(p, n, DAY + timedelta(minutes=at), "failed", None, "x", None) for p, n, at in events]
        spark.createDataFrame(rows, attempts.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        attempts.ingest_stream(spark, str(tmp_path / "in"), stream.passes, stream.root, stream.state, "10 minutes", 3_600_000, buckets=1).awaitTermination()
        return stream.table("passes", "pass_id", "status", "attempts")

    assert send(("a", 1, 0), ("b", 1, 20), ("c", 1, 10)) == []
    # c goes on, so its end moves; the end of a passes, and its timer was the one of all
    assert send(("c", 2, 50), ("d", 1, 75)) == [("a", "open", 1)]
    assert send(("d", 2, 100)) == [("a", "open", 1), ("b", "open", 1)]
    assert send(("d", 3, 200)) == [("a", "open", 1), ("b", "open", 1), ("c", "open", 2)]
    assert stream.table("attempts", "pass_id", "attempt_number")[-3:] == [("d", 1), ("d", 2), ("d", 3)]
