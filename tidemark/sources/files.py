"""Scans of files and of documents inside text: CSV lists, embedded JSON, manifests, hashes, logs and catalogs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.jsonx import canonical_json, json_string
from tidemark.sources.bytes import csv_records

BOM = "﻿"
#: Pauses of a recording that count are eight seconds or longer.
LONG_PAUSE_MS = 8000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; on one machine a folder is made where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose first name may begin with a byte order mark; cells may hold line breaks."""
    return csv_records(spark, path, schema, "*.csv")


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """``session, source_page`` of a source list."""
    return read_csv(spark, path, "session string, source_page string, source_type string").select(F.col("session").cast("int").alias("session"), "source_page")


def embedded_json(text: Column, name: str) -> Column:
    """The JSON text of a script constant; null where it is missing or no JSON. The script is never run."""
    found = F.regexp_extract(text, f"(?m)^const {name}=(.*);\\s*$", 1)
    return F.when(canonical_json(F.when(found != "", found)).isNotNull(), found)


def manifest_entries(manifests: DataFrame, session: int | Column, level: str, required: tuple[tuple[str, str], ...]) -> DataFrame:
    """Per manifest, its entries of a session and level by asset and section, and whether exactly the required ones are there.

    ``manifests``: doc and raw, JSON with an array ``entries``. Of entries with one key the
    last counts.
    """
    item = "array<struct<session:int,level:string,asset:string,section:string,path:string,sha256:string,size_bytes:bigint>>"
    rows = manifests.select("doc", F.posexplode_outer(F.from_json("raw", f"entries {item}")["entries"]).alias("pos", "e"))
    mine = (F.col("e.session") == session) & (F.col("e.level") == level)
    key = F.concat_ws("/", F.col("e.asset"), F.col("e.section"))
    got = rows.groupBy("doc").agg(F.count_if(mine).alias("entries"), F.array_sort(F.collect_set(F.when(mine, key))).alias("keys"))
    wanted = F.array(*[F.lit(f"{a}/{s}") for a, s in sorted(required)])
    return got.select("doc", "entries", "keys", ((F.col("entries") == len(required)) & (F.size(F.array_except(wanted, "keys")) == 0)).alias("complete"))


def strict_objects(raw: Column) -> Column:
    """The fault of a text that must be a JSON object, or null."""
    parsed = canonical_json(raw)
    return F.when(parsed.isNull(), "invalid_json").when(~parsed.startswith("{"), "not_an_object")


def permissive_json(raw: Column) -> Column:
    """Canonical JSON; a text that is none is kept as a JSON string."""
    return F.coalesce(canonical_json(raw), json_string(raw))


def pauses(lines: DataFrame, line: str, *keep: str) -> DataFrame:
    """The kept columns, start_ms and end_ms of the long pauses that lines of a detection log tell.

    A line tells of a whole pause, so each is read alone, and a log of any length, or a third
    of all lines, is spread over all tasks.
    """
    told = "silence_end:\\s*([0-9.]+)\\s*\\|\\s*silence_duration:\\s*([0-9.]+)"
    end, length = (F.regexp_extract(line, told, i) for i in (1, 2))
    rows = lines.where(F.col(line).contains("silence_end")).select(*keep, end.try_cast("double").alias("__end"), length.try_cast("double").alias("__length"))
    ms = lambda x: F.bround(x * 1000).cast("long")
    return rows.where(F.col("__length") * 1000 >= LONG_PAUSE_MS).select(*keep, ms(F.col("__end") - F.col("__length")).alias("start_ms"), ms(F.col("__end")).alias("end_ms"))


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, position, column_name, type`` of the given tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, type string")


def in_catalog_order(df: DataFrame, columns: DataFrame, table: str) -> DataFrame:
    """The columns of a table in the order of a catalog."""
    order = columns.where(F.col("table_name") == table).orderBy("position").select("column_name").collect()
    return df.select(*[r.column_name for r in order])
