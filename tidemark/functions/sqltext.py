"""SQL texts with positional marks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Strings, quoted names, comments, and the mark itself.
TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\?", re.S)


def named_marks(sql: str) -> tuple[str, int]:
    """The SQL with every mark outside of strings, names and comments named :p1, :p2, ..., and their number."""
    n = 0

    def name(m: re.Match) -> str:
        nonlocal n
        if m.group() != "?":
            return m.group()
        n += 1
        return f":p{n}"

    return TOKEN.sub(name, sql), n


def run(spark: SparkSession, sql: str, *values, **tables: DataFrame) -> DataFrame:
    """Runs SQL with one value for each mark; ``tables`` stand for ``{name}`` in it."""
    named, n = named_marks(sql)
    if n != len(values):
        raise ValueError(f"{n} marks, {len(values)} values")
    return spark.sql(named, args={f"p{i}": v for i, v in enumerate(values, 1)}, **tables)
