"""Sinks: inventories, publication without overwriting, staged loads, snapshots and archives.

Spark's commit makes a folder visible as a whole; a manifest that is written last tells
which folders count.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.expect import manifest_compare
from tidemark.sources.bytes import file_hashes
from tidemark.sources.files import BOM


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a byte order mark before the header of every file; refuses to overwrite."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="", encoding="UTF-8")


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    row.coalesce(1).write.mode("errorifexists").json(path, ignoreNullFields=False)


def replace_summary(row: DataFrame, root: str, version: int) -> None:
    """A new version of a summary; readers see the old one until the new one is whole, for a folder appears at once."""
    write_summary(row, f"{root}/version={version:06d}")


def newest_summary(spark: SparkSession, root: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, version int").option("basePath", root).json(root)
    newest = rows.agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), "version").drop("version")


def publish(df: DataFrame, path: str) -> str:
    """Writes a table unless the path is taken: ``published`` or ``exists``."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return "exists"
    return "published"


def load_all(tables: dict[str, DataFrame], root: str, gates: dict[str, list]) -> DataFrame:
    """Loads all tables or none into an empty target, and returns one row for each: table, rows, violations, status.

    Tables are staged, their gates (columns that must hold) are checked on the staged
    rows, and only a manifest that is written last makes them count.
    """
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, df in tables.items():
        staged = f"{root}/staging/{name}"
        if publish(df, staged) == "exists":
            raise ValueError(f"target is not empty: {staged}")
        broken = [F.count_if(~F.coalesce(g, F.lit(False))) for g in gates.get(name, [])]
        n, *bad = spark.read.parquet(staged).agg(F.count(F.lit(1)), *broken).first()
        out.append((name, n, sum(bad)))
    sound = not any(bad for _, _, bad in out)
    rows = spark.createDataFrame([(name, n, bad, "loaded" if sound else "refused") for name, n, bad in out], "table string, rows long, violations long, status string")
    if sound:
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest")
    return rows


def loaded(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A loaded table; None where the load was refused or is not finished."""
    try:
        names = {r["table"] for r in spark.read.parquet(f"{root}/manifest").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.parquet(f"{root}/staging/{table}") if table in names else None


def snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """Writes a version that never changes afterwards, and reads it."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_rows(df: DataFrame, path: str) -> DataFrame:
    """Adds rows to a table that only grows, and reads it."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(lines: DataFrame, key: str, order: str, path: str) -> None:
    """One text file for each key, its lines in order; ``lines``: key, order, line."""
    lines.repartition(key).sortWithinPartitions(key, order).select(key, F.col("line").alias("value")).write.mode("errorifexists").partitionBy(key).text(path)


def freeze(spark: SparkSession, path: str, manifest: str, key: str) -> DataFrame:
    """Hashes the files below a path and publishes their manifest; one that is there already is not replaced."""
    name = F.regexp_extract("path", f"{key}=([^/]+)/", 1)
    rows = file_hashes(spark, path, "*.txt").select(name.alias(key), "size", "sha256")
    if publish(rows, manifest) == "exists":
        raise ValueError(f"archive is frozen: {manifest}")
    return spark.read.parquet(manifest)


def verify_archive(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Files against a manifest: same, changed, missing or unexpected; size and hash count."""
    both = lambda df: df.select(key, F.concat_ws(":", "size", "sha256").alias("state"))
    return manifest_compare(both(manifest), both(files), key, "state")
