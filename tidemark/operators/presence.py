"""Where findings were present, as bitmaps.

A bitmap is a sorted array of (word, bits): number n, from 1, is bit (n - 1) % 63 of word
(n - 1) div 63, and words without a bit are left out. It takes sixteen bytes for 63 runs,
and first sight, reappearance and the runs between are bit operations on it. An item that
stands for no finding (``whole``) carries the runs of a subject along, so that nothing is
joined back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 63


def word_of(number: Column) -> Column:
    return F.floor((number - 1) / BITS).cast("int")


def bit_of(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number - 1, F.lit(BITS)).cast("int"))


def bitmaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, bits``: the numbers of each group. Repeated rows change nothing."""
    n = F.col(number)
    words = rows.groupBy(*keys, word_of(n).alias("__word")).agg(F.bit_or(bit_of(n)).alias("__bits"))
    return words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__word").alias("word"), F.col("__bits").alias("bits")))).alias("bits"))


def has(bits: Column, number: Column) -> Column:
    """Whether a number is in a bitmap; false if either is null."""
    return F.coalesce(F.exists(bits, lambda x: (x["word"] == word_of(number)) & (x["bits"].bitwiseAND(bit_of(number)) != 0)), F.lit(False))


def both(a: Column, b: Column) -> Column:
    """The numbers of both bitmaps; ``b`` has no gaps between its words, as numbers from 1 have none."""
    shared = F.transform(a, lambda x: F.struct(x["word"].alias("word"), x["bits"].bitwiseAND(F.coalesce(F.get(b, x["word"])["bits"], F.lit(0).cast("long"))).alias("bits")))
    return F.filter(shared, lambda x: x["bits"] != 0)


def without(bits: Column, number: Column) -> Column:
    cleared = F.transform(bits, lambda x: F.struct(x["word"].alias("word"), F.when(x["word"] == word_of(number), x["bits"].bitwiseAND(F.bitwise_not(bit_of(number)))).otherwise(x["bits"]).alias("bits")))
    return F.filter(cleared, lambda x: x["bits"] != 0)


def count(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"]))


def lowest(bits: Column) -> Column:
    """The least number, or null: the bits below the lowest one are counted."""
    first = F.get(bits, F.lit(0))
    return first["word"] * BITS + F.bit_count(first["bits"].bitwiseAND(-first["bits"]) - 1) + 1


def numbers(bits: Column) -> Column:
    """All numbers in order."""
    inside = lambda x: F.filter(F.sequence(F.lit(1), F.lit(BITS)), lambda i: F.call_function("getbit", x["bits"], i - 1) == 1)
    return F.flatten(F.transform(bits, lambda x: F.transform(inside(x), lambda i: x["word"] * BITS + i)))


def found_states(runs: DataFrame) -> DataFrame:
    """Per subject and fingerprint: where it was seen, and its state in the newest run.

    ``runs``: subject_id, run_id, rank (1 for the newest run of the subject, without gaps),
    complete, and findings, an array of (fingerprint, n) with each fingerprint once. Presence
    counts over complete runs only; runs where a finding was seen count all runs. A finding
    that is not reproduced is never called resolved.

    All rows of a subject meet once, by the subject; the names and the completeness of its
    runs come along as an item of their own, so runs are not joined.
    """
    keys = ["subject_id", "whole", "fingerprint"]
    item = lambda whole, fingerprint, n: F.struct(F.lit(whole).alias("whole"), fingerprint.alias("fingerprint"), n.cast("long").alias("n"))
    items = F.concat(F.array(item(True, F.lit(None).cast("string"), F.lit(0))), F.transform("findings", lambda x: item(False, x["fingerprint"], x["n"])))
    rows = runs.select("subject_id", "run_id", "rank", "complete", F.explode(items).alias("i")).select("subject_id", "run_id", "rank", "complete", "i.*")
    seen = F.array_sort(F.collect_list(F.struct("rank", "run_id", "n")))
    mark = bit_of(F.col("rank"))
    words = rows.groupBy(*keys, word_of(F.col("rank")).alias("word")).agg(F.bit_or(mark).alias("bits"), F.bit_or(F.when(F.col("complete"), mark).otherwise(0)).alias("done"), F.sum("n").alias("n"), seen.alias("runs"))
    maps = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word", "bits", "done", "runs"))).alias("w"), F.sum("n").alias("occurrence_count"))
    picked = lambda name: F.transform("w", lambda x: F.struct(x["word"].alias("word"), x[name].alias("bits")))
    maps = maps.select(*keys, "occurrence_count", picked("bits").alias("bits"), picked("done").alias("done"), F.flatten(F.transform("w", lambda x: x["runs"])).alias("runs"))
    first = Window.partitionBy("subject_id").orderBy(F.desc("whole"))
    whole = F.first(F.when(F.col("whole"), F.struct(F.col("done").alias("complete"), F.transform("runs", lambda x: x["run_id"]).alias("names"))), True).over(first)
    rows = maps.withColumn("all", whole).where(~F.col("whole"))
    complete, names = F.col("all.complete"), F.col("all.names")
    one = F.lit(1)
    rows = rows.withColumns({"latest_complete": has(complete, one), "now": has(F.col("bits"), one), "prev": lowest(without(both(F.col("bits"), complete), one))})
    # complete runs between the newest and the one before that had it
    gap = F.filter(numbers(complete), lambda k: (k > 1) & (k < F.col("prev")))
    rows = rows.withColumn("gap", F.when(F.col("latest_complete") & F.col("now") & F.col("prev").isNotNull(), gap).otherwise(F.array().cast("array<int>")))
    state = F.when(~F.col("latest_complete"), "latest_run_incomplete").when(F.size("gap") > 0, "reappeared_in_latest_run").when(F.col("now"), "present_in_latest_run").otherwise("not_reproduced_in_latest_run")
    return rows.select(
        "subject_id", "fingerprint", count(F.col("bits")).alias("seen_run_count"), "occurrence_count", F.element_at("runs", -1)["run_id"].alias("first_seen_run_id"), F.element_at("runs", 1)["run_id"].alias("latest_seen_run_id"),
        F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["run_id"], x["n"])), ",").alias("occurrences_by_run"),
        state.alias("latest_state"), F.array_join(F.transform("gap", lambda k: F.element_at(names, k)), ",").alias("intervening_runs"),
    )
