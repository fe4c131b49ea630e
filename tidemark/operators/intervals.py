"""Pauses of a sequence, and the all-or-nothing proposal of intervals between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Windows whose long first part and short second part form one interval.
SHARED = ((25, 26), (27, 28), (29, 30))


def pause_gaps(events: DataFrame, key: str, ts_ms: str, order: str) -> DataFrame:
    """The time since the previous event of each key."""
    w = Window.partitionBy(key).orderBy(ts_ms, order)
    prev = F.lag(ts_ms).over(w)
    return events.select(key, order, prev.alias("start_ms"), F.col(ts_ms).alias("end_ms"), (F.col(ts_ms) - prev).alias("gap_ms")).where("start_ms is not null")


def overlaps(pauses: DataFrame, key: str) -> DataFrame:
    """Pauses that do not end before the next begins."""
    following = F.lead("start_ms").over(Window.partitionBy(key).orderBy("start_ms", "end_ms"))
    return pauses.withColumn("next_start_ms", following).where("end_ms >= next_start_ms")


def propose(pauses: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Intervals between 31 long pauses of each key; none where one rule is broken.

    ``pauses``: key, start_ms, end_ms. ``durations``: key, duration_ms, source_sha256.
    """
    p = pauses.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("p")).join(durations, key)
    d = F.col("duration_ms")
    each = F.forall("p", lambda x: (x["start_ms"] >= 0) & (x["end_ms"] - x["start_ms"] >= 8000))
    p = p.where((F.size("p") == 31) & each & (F.array_max(F.transform("p", lambda x: x["end_ms"])) <= d + 150))
    p = p.withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(F.get("p", i - 1)["end_ms"].alias("a"), F.get("p", i)["start_ms"].alias("b"))))
    length = lambda i: F.get("w", F.lit(i - 1))["b"] - F.get("w", F.lit(i - 1))["a"]
    ok = F.forall("w", lambda x: (x["b"] > x["a"]) & (x["b"] - x["a"]).between(500, 150000))
    for first, second in SHARED:
        ok = ok & (length(first) > 60000) & length(second).between(500, 3500)
    groups = F.array(*[F.array(F.lit(i)) for i in range(1, 25)], *[F.array(F.lit(a), F.lit(b)) for a, b in SHARED])
    rows = p.where(ok).select(key, "source_sha256", "duration_ms", "w", F.explode(groups).alias("questions"))
    at = lambda q: F.get("w", q - 1)
    return rows.select(key, "questions", F.greatest(F.lit(0), at(F.element_at("questions", 1))["a"] - 150).alias("start_ms"), F.least("duration_ms", at(F.element_at("questions", -1))["b"] + 150).alias("end_ms"), "source_sha256", F.lit("candidate_unverified").alias("status"), (F.size("questions") > 1).alias("contains_response_pause"))


def threshold_stability(pauses: DataFrame, key: str, primary: str, tolerance_ms: int = 120, count: int | None = 31) -> DataFrame:
    """Per key: do all thresholds have the primary's pauses, each within the tolerance?"""
    ranked = pauses.withColumn("__k", F.row_number().over(Window.partitionBy(key, "threshold").orderBy("start_ms", "end_ms")))
    base = ranked.where(F.col("threshold") == primary).select(key, "__k", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    near = (F.abs(F.col("start_ms") - F.col("s")) <= tolerance_ms) & (F.abs(F.col("end_ms") - F.col("e")) <= tolerance_ms)
    per = ranked.join(base, [key, "__k"], "left").groupBy(key, "threshold").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce(near, F.lit(False))).alias("near"))
    same = F.min("n") == F.max("n")
    return per.groupBy(key).agg((F.every("near") & same & (F.lit(True) if count is None else F.min("n") == count)).alias("stable"), F.max("n").alias("pauses"))
