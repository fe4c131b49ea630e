"""Mutations as pure functions from the old rows and the changes to the new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered


def insert_ignore(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Classifies new rows: inserted, already_imported, or conflict where the content differs.

    Of new rows that share a key the least content is inserted first, and the others are
    compared with it.
    """
    stored = old.select(key, F.col(content).alias("__old"))
    least = new.groupBy(F.col(key).alias("__key")).agg(F.min(content).alias("__first"))
    rows = numbered(new, [key], [content], "__turn").join(stored, key, "left").join(least, F.col(key).eqNullSafe(F.col("__key")))
    against = F.coalesce("__old", "__first")
    status = F.when(F.col("__old").isNull() & (F.col("__turn") == 1), "inserted").when(against == F.col(content), "already_imported").otherwise("conflict")
    return rows.select(key, content, status.alias("status"))


def replace_values(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the same keys are replaced, others stay, new ones are added."""
    return old.join(changes.select(key), key, "left_anti").unionByName(changes)


def upsert_versioned(old: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """New rows begin at version 1, changed values count up, equal values stay."""
    c = changes.select(key, F.col(value).alias("__new"))
    changed = F.col("__new").isNotNull() & ~F.col(value).eqNullSafe(F.col("__new"))
    version = F.when(F.col("version").isNull(), 1).when(changed, F.col("version") + 1).otherwise(F.col("version"))
    return old.join(c, key, "full").select(key, F.coalesce("__new", value).alias(value), version.cast("long").alias("version"))


def guarded_update(old: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Applies a change only where the stored value is the one it was made for."""
    rows = old.join(changes.select(key, "before", "after"), key, "left")
    ok = F.col(value).eqNullSafe(F.col("before"))
    return rows.select(key, F.when(ok & F.col("after").isNotNull(), F.col("after")).otherwise(F.col(value)).alias(value), F.when(F.col("after").isNull(), "untouched").when(ok, "updated").otherwise("refused").alias("status"))


def upgrade_triage(rows: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """``rows``: key, status, text, baseline, new. Human work is never overwritten."""
    human = reviewed.select(key).distinct().withColumn("__manual", F.lit(True))
    kind = (
        F.when((F.col("status") != "pending") | F.col("__manual").isNotNull(), "reviewed")
        .when(~F.col("text").eqNullSafe(F.col("baseline")), "edited")
        .when(~F.col("text").eqNullSafe(F.col("new")), "update")
        .otherwise("unchanged")
    )
    return rows.join(human, key, "left").select(key, kind.alias("action"))


def allocate_ids(old: DataFrame, new: DataFrame, group: str, number: str, order: list[str]) -> DataFrame:
    """Continues the numbering of each group after its greatest number."""
    top = old.groupBy(group).agg(F.max(number).alias("__top"))
    rows = numbered(new, [group], order, "__n")
    return rows.join(top, group, "left").withColumn(number, F.coalesce("__top", F.lit(0)) + F.col("__n")).drop("__top", "__n")


def monotone_violations(checkpoints: DataFrame, key: str, sequence: str, ids: str) -> DataFrame:
    """Checkpoints that lost an id of the one before."""
    before = F.lag(ids).over(Window.partitionBy(key).orderBy(sequence))
    lost = F.size(F.array_except(before, F.col(ids)))
    return checkpoints.withColumn("lost", F.when(before.isNotNull(), lost).otherwise(0).cast("long")).where("lost > 0").select(key, sequence, "lost")
