"""Loads of tables that refer to each other: in order, checked, and all or none."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.multiset import LANES, multiset_digests
from tidemark.sinks.files import publish

#: table, column, referred table, referred column
Reference = tuple[str, str, str, str]


def load_order(tables: list[str], references: list[Reference]) -> list[str]:
    """Tables after those they refer to, by name where that leaves a choice; a table may refer to itself.

    Raises ValueError that names a cycle.
    """
    graph = {t: {r[2] for r in references if r[0] == t and r[2] != t} for t in tables}
    sorter = TopologicalSorter(graph)
    try:
        sorter.prepare()
    except CycleError as e:
        # each table of the ring is referred to by the next; read backwards it follows the references
        ring = e.args[1][:0:-1]
        at = ring.index(min(ring))
        raise ValueError("cycle: " + " > ".join([*ring[at:], *ring[:at], ring[at]])) from e
    order = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        order += ready
        sorter.done(*ready)
    return [t for t in order if t in graph]


def orphans(rows: DataFrame, column: str, target: DataFrame, key: str) -> int:
    """Rows whose reference is not null and leads nowhere.

    Equal references are counted before the shuffle, so one key with a third of all rows is
    one row of each task. References that hold are the rule, so a Bloom filter of the keys
    would let nearly all pass; only the distinct ones meet the keys.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__k")).count()
    lost = counted.join(target.select(F.col(key).alias("__k")), "__k", "left_anti")
    return lost.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def _digest(df: DataFrame) -> str:
    row = multiset_digests(df, df.columns, []).first()
    return ":".join(str(row[c]) for c in ("n_rows", *LANES))


def load_ordered(sources: dict[str, Callable[[], DataFrame]], references: list[Reference], root: str) -> DataFrame:
    """Loads all tables or none into an empty target: ``table, position, rows, orphans, status``.

    A source is opened twice. It is hashed and staged, references are checked on the staged
    rows in the order of the load, and the source is hashed again before the commit; where it
    changed on the way, or what was staged is not what was hashed, nothing becomes visible.
    The status of a table is ``loaded``, its own fault (``broken reference``, ``source
    changed``), or ``held back`` for the faults of others.
    """
    order = load_order(list(sources), references)
    spark, first, staged, found = None, {}, {}, []
    for name in order:
        df = sources[name]()
        spark = df.sparkSession
        first[name] = _digest(df)
        path = f"{root}/staging/{name}"
        if publish(df, path) == "exists":
            raise ValueError(f"target is not empty: {path}")
        staged[name] = spark.read.schema(df.schema).parquet(path)
        found.append(sum(orphans(staged[name], c, staged[t2], c2) for t, c, t2, c2 in references if t == name))
    changed = [not first[n] == _digest(staged[n]) == _digest(sources[n]()) for n in order]
    sound = not any(found) and not any(changed)
    status = ["loaded" if sound else "source changed" if c else "broken reference" if n else "held back" for n, c in zip(found, changed, strict=True)]
    rows = [(name, i, int(first[name].split(":")[0]), found[i - 1], status[i - 1]) for i, name in enumerate(order, 1)]
    out = spark.createDataFrame(rows, '`table` string, position long, rows long, orphans long, status string')
    if sound:
        out.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest")
    return out
