"""Ingest of audit results as a stateful stream, with attempts, retries and checkpoints.

Events of a pass arrive as files: responses, attempts that failed or timed out, and
checkpoints. A response is validated by the column functions of the batch ingest; what
becomes of it depends on the pass, whose state is kept between batches:

* number of attempts so far, the digest of the result once one succeeded, the largest
  event number, and the last checkpoint with the subjects completed so far;
* an event whose number is not above the largest one of its pass was seen before, and
  changes nothing; events of a pass are numbered in the order in which they happened;
* a sound response ends the pass; the same result again changes nothing, and another
  result, attempt or checkpoint is refused;
* a checkpoint must hold all subjects of the one before;
* a timer of event time ends the state ``keep`` after the last event of a pass, and closes
  the pass; what arrives behind the watermark is dropped, so state is bounded by the
  passes of that time.

Repeats of an event within the delay of the watermark are dropped by their number before they
are validated, which costs far more than to know them. A call to the state costs more than the
decision on a pass, so passes are dealt to ``buckets`` by their hash, and the state of a bucket
is read and written once in a batch. The number of buckets holds as long as the checkpoint; some
dozens of live passes in each are a good measure.

Each batch goes to the tables in folders of its own number, which a repeated batch
replaces: a batch that ran twice, after an executor or the driver was lost, changes nothing.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ingest import read_responses

EVENT = "pass_id string, number long, at timestamp, kind string, raw string, error_code string, completed array<string>"
#: Events that are attempts without a result.
FAILED = ("failed", "timed_out")
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DECISION = "pass_id string, number long, table string, status string, attempt_number long, error string, response_sha256 string, completed array<string>, verdicts string, occurrences string"
#: The passes of a bucket as a JSON object of (attempts, done, last, checkpoint, completed, until), and the time of its timer.
STATE = "passes string, timer long"
NEW = (0, None, -1, 0, [], 0)
VERDICTS = "array<struct<subject:string,verdict:string,confidence:double,rationale:string,position:int>>"
OCCURRENCES = "array<struct<subject:string,category:string,severity:string,summary:string,detail:string,identity:string,fingerprint:string>>"
COLUMNS = {
    "attempts": "pass_id, attempt_number, status, error, response_sha256",
    "checkpoints": "pass_id, attempt_number as sequence, completed",
    "refusals": "pass_id, number, status, error",
    "passes": "pass_id, status, attempt_number as attempts",
}


class Passes(StatefulProcessor):
    """Decides on the events of each pass of a bucket in their order; ``keep`` is in milliseconds."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, timer = self.state.get() if self.state.exists() else ("{}", None)
        passes, events, out = json.loads(held), defaultdict(list), []
        for e in rows:
            events[e.pass_id].append(e)
        for name, said in events.items():
            passes[name] = self._decide(name, passes.get(name, NEW), sorted(said, key=lambda e: e.number), out)
        self._keep(passes, timer)
        yield from map(_decision, out)

    def _decide(self, name: str, held, events: list[Row], out: list[dict]) -> tuple:
        attempts, done, last, checkpoint, completed, until = held
        for e in events:
            if e.number <= last:
                continue
            last, until = e.number, max(until, e.at_ms + self.keep)
            row = {"pass_id": name, "number": last}
            error = e.error
            if e.kind == "response" and done is not None and error is None and e.response_sha256 == done:
                continue
            if done is not None:
                out.append(row | {"table": "refusals", "status": e.kind, "error": "pass has a result"})
            elif e.kind == "checkpoint":
                now = [] if e.completed is None else list(e.completed)
                if set(completed) <= set(now):
                    completed, checkpoint = now, checkpoint + 1
                    out.append(row | {"table": "checkpoints", "attempt_number": checkpoint, "completed": now})
                else:
                    out.append(row | {"table": "refusals", "status": e.kind, "error": "checkpoint lost subjects"})
            else:
                attempts += 1
                sound = e.kind == "response" and error is None
                row |= {"table": "attempts", "attempt_number": attempts, "error": error, "response_sha256": e.response_sha256}
                out.append(row | {"status": "succeeded" if sound else "invalid" if e.kind == "response" else e.kind} | ({"verdicts": e.verdicts, "occurrences": e.occurrences} if sound else {}))
                done = e.response_sha256 if sound else None
        return attempts, done, last, checkpoint, completed, until

    def _keep(self, passes: dict, timer: int | None) -> None:
        """Stores a bucket, whose one timer is never later than the first end of a pass; it may be earlier, as ends move on."""
        first = min(p[5] for p in passes.values())
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.state.update((json.dumps(passes, ensure_ascii=False, separators=(",", ":")), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passes, now = json.loads(self.state.get()[0]), timerValues.getCurrentWatermarkInMs()
        ended = {name: p for name, p in passes.items() if p[5] <= now}
        left = {name: p for name, p in passes.items() if name not in ended}
        if left:
            self._keep(left, None)
        else:
            self.state.clear()
        for name, (attempts, done, last, *_) in ended.items():
            yield _decision({"pass_id": name, "number": last, "table": "passes", "status": "open" if done is None else "done", "attempt_number": attempts})


NAMES = [c.split()[0] for c in DECISION.split(", ")]


def _decision(row: dict) -> Row:
    return Row(**{name: row.get(name) for name in NAMES})


def decisions(events: DataFrame, passes: DataFrame, delay: str = "1 hour", keep: int = 86_400_000, buckets: int = 4096) -> DataFrame:
    """What becomes of each event of a stream (or of a table read as one); ``passes`` as for the batch ingest."""
    events, event = events.withColumnRenamed("completed", "completed_now").withWatermark("at", delay), ["pass_id", "number"]
    once = events.dropDuplicatesWithinWatermark(event) if events.isStreaming else events.dropDuplicates(event)
    checked = read_responses(once, passes)
    subjects, verdicts = F.col("subjects"), F.col("verdicts")
    judged = F.transform(verdicts, lambda x: F.struct(x["subject"].alias("subject"), x["verdict"].alias("verdict"), x["confidence"].alias("confidence"), x["rationale"].alias("rationale"), F.array_position(subjects, x["subject"]).alias("position")))
    found = F.transform(F.arrays_zip("findings", "identities", "fingerprints"), lambda x: F.struct(*[x["findings"][c].alias(c) for c in ("subject", "category", "severity", "summary", "detail")], x["identities"].alias("identity"), x["fingerprints"].alias("fingerprint")))
    is_response = F.col("kind") == "response"
    sound = is_response & F.col("error").isNull()
    rows = checked.select(
        F.pmod(F.xxhash64("pass_id"), F.lit(buckets)).alias("bucket"), "pass_id", "number", "at", F.unix_millis("at").alias("at_ms"), "kind", F.col("completed_now").alias("completed"), F.when(is_response, F.col("error")).otherwise(F.col("error_code")).alias("error"),
        F.when(is_response, F.sha2(F.coalesce("canonical", "raw"), 256)).alias("response_sha256"), F.when(sound, F.to_json(judged)).alias("verdicts"), F.when(sound, F.to_json(found)).alias("occurrences"),
    )
    return rows.groupBy("bucket").transformWithState(Passes(keep), DECISION, "Append", "EventTime")


def write_batch(rows: DataFrame, batch: int, root: str) -> None:
    """The decisions of a batch as folders of all tables; a folder that is there already is replaced.

    The decisions are stored first, so that each table reads its own columns only and none is held in
    memory. After the first batch, tables without rows are left out.
    """
    staged = f"{root}/decided"
    rows.write.mode("overwrite").parquet(staged)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(staged)
    found = {r["table"]: r for r in rows.groupBy("table").agg(F.count("verdicts").alias("verdicts"), F.count("occurrences").alias("occurrences")).collect()}

    def put(df: DataFrame, name: str, some: bool) -> None:
        if some or not batch:
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    for name, columns in COLUMNS.items():
        put(rows.where(F.col("table") == name).selectExpr(*columns.split(", ")), name, name in found)
    for name, kind in (("verdicts", VERDICTS), ("occurrences", OCCURRENCES)):
        put(rows.where(F.col(name).isNotNull()).select("pass_id", F.explode(F.from_json(name, kind)).alias("x")).select("pass_id", "x.*"), name, any(r[name] for r in found.values()))


def ingest_stream(spark: SparkSession, path: str, passes: DataFrame, root: str, checkpoint: str, delay: str = "1 hour", keep: int = 86_400_000, files_each: int | None = None, buckets: int = 4096):
    """Starts the ingest of all event files (Parquet of EVENT) that are there and not ingested yet."""
    for name, value in STORE.items():
        spark.conf.set(name, value)
    source = spark.readStream.schema(EVENT)
    if files_each:
        source = source.option("maxFilesPerTrigger", files_each)
    out = decisions(source.parquet(path), passes, delay, keep, buckets)
    writer = out.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, root))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the stream, with the ``batch`` of each row; an empty one where nothing was ingested."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "pass_id string, batch int")
