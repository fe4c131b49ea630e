"""Fail-closed expectations: each returns the rows, or counts, that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pk_violations(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fk_violations(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")


def check_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break; a null result passes, as in SQL."""
    broken = F.filter(F.array(*[F.when(~ok, name) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def suite(df: DataFrame, checks: dict[str, tuple[Column, object]]) -> DataFrame:
    """(check_name, expected, actual, ok) of named aggregates, in one pass over the rows."""
    row = df.agg(*[agg.cast("string").alias(name) for name, (agg, _) in checks.items()])
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(str(e)).alias("expected"), F.col(n).alias("actual")) for n, (_, e) in checks.items()]))
    return row.select(one.alias("c")).select("c.*", F.coalesce(F.col("c.expected") == F.col("c.actual"), F.lit(False)).alias("ok"))


#: Kinds whose text holds neither a separator nor an escape.
PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def row_hash(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 of a row with marked nulls and escaped separators."""
    kinds = {name.lower(): kind for name, kind in df.dtypes}

    def text(c: str) -> Column:
        said = F.col(c).cast("string")
        if kinds.get(c.lower(), "").startswith("decimal") or kinds.get(c.lower()) in PLAIN:
            return said
        return F.replace(F.replace(said, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))

    cell = [F.coalesce(F.concat(F.lit("v"), text(c)), F.lit("n")) for c in cols]
    return F.sha2(F.concat_ws("|", *cell), 256)


def table_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-insensitive digest in levels.

    Rows are hashed and counted, and put in buckets by the first digits of their hash; a
    bucket is digested in sorted order, then the digests of buckets that share all but
    three digits, and so on up to one. The number of digits follows the number of rows,
    so no task holds more than about 4096 hashes at once.
    """
    rows = df.select(row_hash(df, cols).alias("h"))
    n, digits = rows.count(), 3
    while n > 4096 * 16**digits:
        digits += 3
    one = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.substring("h", 1, digits).alias("b"), F.concat_ws("*", "h", "n").alias("x"), "n")
    level = one.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("d"), F.sum("n").alias("n"))
    while digits:
        digits -= 3
        level = level.groupBy(F.substring("b", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"]), "\n"), 256).alias("d"), F.sum("n").alias("n"))
        level = level.withColumnRenamed("p", "b")
    return level.select(F.col("n").alias("n_rows"), F.col("d").alias("digest"))


def canonical_row(df: DataFrame, cols: list[str]) -> Column:
    """A row as canonical JSON: keys sorted, nulls kept, binaries as their length and SHA-256."""
    binary = {f.name for f in df.schema.fields if f.dataType.typeName() == "binary"}
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.octet_length(c).alias("len"), F.sha2(F.col(c), 256).alias("sha256"))).alias(c) if c in binary else F.col(c)
    return F.to_json(F.struct(*[value(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def exact_digests(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Per group, SHA-256 of its rows' canonical JSON in code point order, joined by line feeds; groups must be bounded."""
    rows = df.select(group, canonical_row(df, cols).alias("r")).groupBy(group).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select(group, F.size("r").cast("long").alias("n_rows"), F.sha2(F.array_join("r", "\n"), 256).alias("digest"))


def multiset_diff(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that one side has more often, with the difference of their counts."""
    both = left.select(*cols, F.lit(1).alias("__n")).union(right.select(*cols, F.lit(-1).alias("__n")))
    return both.groupBy(*cols).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def table_parity(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per table of two stores: columns, counts, digests and rows that differ. A missing table is a difference unless both lack it."""
    out = None
    for name, (left, right) in pairs.items():
        if left is None or right is None:
            spark = (left or right).sparkSession
            row = spark.createDataFrame([(name, False, None, None, False)], "table string, same_columns boolean, left_rows long, right_rows long, same_rows boolean")
        else:
            same = left.columns == right.columns
            cols = [c for c in left.columns if c in right.columns]
            sides = [table_digest(df, cols).select(F.lit(name).alias("table"), F.col("n_rows").alias(f"{s}_rows"), F.col("digest").alias(s)) for df, s in ((left, "left"), (right, "right"))]
            row = sides[0].join(sides[1], "table").select("table", F.lit(same).alias("same_columns"), "left_rows", "right_rows", (F.col("left") == F.col("right")).alias("same_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def structure(tables: dict[str, DataFrame], keys: dict[str, list[list[str]]], references: list[tuple[str, str, str, str]], checks: dict[str, list[str]], defaults: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """``table, kind, name, definition`` of everything that a structure contract holds."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for t, df in tables.items():
        for i, f in enumerate(df.schema.fields, 1):
            rows.append((t, "column", f.name, f"{i} {f.dataType.simpleString()} {'null' if f.nullable else 'not null'} {(defaults or {}).get((t, f.name), '')}".strip()))
    rows += [(t, "key", ",".join(k), "first" if i == 0 else "unique") for t, ks in keys.items() for i, k in enumerate(ks)]
    rows += [(t, "reference", c, f"{t2}({c2})") for t, c, t2, c2 in references]
    rows += [(t, "checks", "count", str(len(cs))) for t, cs in checks.items()]
    return spark.createDataFrame(rows, "table string, kind string, name string, definition string")


def structure_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Everything in which two structures differ."""
    keys = ["table", "kind", "name"]
    rows = expected.withColumnRenamed("definition", "expected").join(actual.withColumnRenamed("definition", "actual"), keys, "full")
    return rows.where("not expected <=> actual")


def append_only_violations(old: DataFrame, new: DataFrame, cols: list[str]) -> DataFrame:
    """Old rows that the new state has less often."""
    return multiset_diff(old, new, cols).where("surplus > 0")


def baseline(df: DataFrame, checks: dict[str, tuple[Column, object]]) -> DataFrame:
    """Whether counts are those that were approved."""
    return suite(df, checks)


def parity_diff(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keys whose rows differ between two copies, and how."""
    a = left.select(F.col(key), row_hash(left, cols).alias("a"))
    b = right.select(F.col(key), row_hash(right, cols).alias("b"))
    kind = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").otherwise("changed")
    return a.join(b, key, "full").where("not a <=> b").select(key, kind.alias("difference"))


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that differ in position, type or nullability between two tables."""
    spark = left.sparkSession
    rows = lambda df: [(f.name, i, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    kind = "column_name string, position long, type string, nullable boolean"
    a, b = (spark.createDataFrame(rows(df), kind) for df in (left, right))
    a, b = a.select("column_name", F.struct("position", "type", "nullable").alias("a")), b.select("column_name", F.struct("position", "type", "nullable").alias("b"))
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a.type") != F.col("b.type"), "type").when(F.col("a.nullable") != F.col("b.nullable"), "nullable").otherwise("position")
    return a.join(b, "column_name", "full").where("not a <=> b").select("column_name", what.alias("difference"), F.col("a.type").alias("left_type"), F.col("b.type").alias("right_type"))


def same_sets(expected: DataFrame, actual: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Per group, whether both sides hold the same set of rows, and how many rows only one side has."""
    a, b = expected.select(group, *cols).distinct().withColumn("__a", F.lit(1)), actual.select(group, *cols).distinct().withColumn("__b", F.lit(1))
    rows = a.join(b, [group, *cols], "full").groupBy(group).agg(F.count_if(F.col("__b").isNull()).alias("missing"), F.count_if(F.col("__a").isNull()).alias("unexpected"))
    return rows.withColumn("same", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def manifest_compare(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two manifests."""
    a, b = expected.select(key, F.col(value).alias("a")), actual.select(key, F.col(value).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))
