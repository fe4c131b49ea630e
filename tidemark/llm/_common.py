"""Helpers shared by the training-data operators.

Everything that outlives one job goes to the shared folder which the cluster
names in ``spark.checkpoint.dir``; nothing is kept in machine-local folders.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. A session on one machine gets one where none is set; a cluster without one is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return root.rstrip("/")


class Workspace:
    """Tables of one operator run in the shared folder.

    ``save`` cuts lineage: the rows are written once as Parquet and read back, so
    a lost executor costs a re-read and not a recomputation. ``drop`` removes a
    table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path, schema = f"{self.path}/{label}", df.schema
        release(self.spark)  # of the step before, which nothing refers to by now
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *labels: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner remove shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


class Range(NamedTuple):
    """An inclusive upper bound, the largest key below it, and the parts of a single heavy key."""

    upper: int
    top: int
    parts: int


def range_edges(df: DataFrame, key: str, target: int, weight: Column | None = None, fanout: int = 16384) -> list[Range]:
    """Deterministic ranges of a long column, each of about ``target`` rows, or weight.

    Weights come from equal-width cells. A cell that weighs more than the target is cut
    again, into no more cells than its weight calls for; which cells go on is told to the
    tasks by a broadcast table. So the driver sees at most ``fanout`` counts and about five
    for each range, and no expression grows with the data. A single key beyond the target
    is a range of its own and has ``parts`` above 1. Null keys are left out. A bound depends
    on the keys alone, never on the order of tasks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("k"), (F.lit(1) if weight is None else weight).cast("long").alias("w")).where("k is not null")
    lo, hi = rows.agg(F.min("k"), F.max("k")).first()
    if lo is None:
        return []
    apart = "cast((cast(k as decimal(20,0)) - start) div width as bigint)" if hi - lo >= 2**62 else "(k - start) div width"
    done: list[tuple[int, int, int]] = []  # upper bound, weight, largest key
    cells = rows.withColumn("cell", F.lit(0).cast("long"))
    heavy = {0: (lo, hi, fanout)}
    while heavy:
        cuts, base = [], 0
        for cell, (start, end, most) in sorted(heavy.items()):
            width = -(-(end - start + 1) // most)
            cuts.append((cell, start, width, base, end))
            base += -(-(end - start + 1) // width)
        table = spark.createDataFrame([c[:4] for c in cuts], "cell long, start long, width long, base long")
        cells = cells.join(F.broadcast(table), "cell").select("k", "w", F.expr(f"base + {apart}").alias("cell"))
        bases, heavy = [c[3] for c in cuts], {}
        for cell, held, top in cells.groupBy("cell").agg(F.sum("w"), F.max("k")).collect():
            _, start, width, base, end = cuts[bisect_right(bases, cell) - 1]
            a = start + (cell - base) * width
            b = min(end, a + width - 1)
            if held > target and a < b:
                heavy[cell] = (a, b, min(b - a + 1, 4 * (held // target) + 5))
            else:
                done.append((b, held, top))
    out, open_ = [], 0
    for upper, held, top in sorted(done):
        if held > target:
            out.append(Range(upper, top, -(-held // target)))
            open_ = 0
            continue
        if open_:
            out.pop()
        out.append(Range(upper, top, 1))
        open_ = 0 if open_ + held >= target else open_ + held
    return out


def long_array(values: list[int]) -> Column:
    """A constant array; one literal that the optimizer folds, however many values there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(key: Column, uppers: list[int]) -> Column:
    """Index of the first bound that is not below the key, by binary search; nulls go to 0."""
    if len(uppers) < 2:
        return F.lit(0)
    inner = uppers[:-1]
    steps = [2**i for i in reversed(range(len(inner).bit_length()))]
    bounds = long_array(inner)
    return F.aggregate(
        F.lit(steps).cast("array<int>") if len(steps) > 1 else F.array(F.lit(1)),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) < key, F.lit(False)), at + step).otherwise(at),
    )


def with_slots(df: DataFrame, group: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each group without gaps from 0.

    ``cell`` divides a group in ordered parts of bounded size: rows are ranked in
    their cell, and the counts of the earlier cells of the group are added. So a
    group that holds a third of all rows is ranked by many tasks. ``df`` must be a
    written table, for it is read twice.
    """
    counts = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*group, cell, F.coalesce(before, F.lit(0)).alias("__start"))
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)))
    return ranked.join(starts, [*group, cell]).withColumn(name, (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__start", "__rank")


def task_count(spark: SparkSession) -> int:
    """The number of reduce tasks that the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
