"""Digests of row multisets that add up, and hash trees built of them.

The digest of a multiset is its count and, for each of four 64-bit lanes of the rows'
SHA-256, the sum modulo 2**64. So the digest of a union is the sum of the digests of its
parts: partial sums are combined before the shuffle, a log's digest follows from the old one
and the new rows, and an inner node of a tree follows from its children. Sums find rows that
were lost, changed or repeated by fault; they are no defence against rows that are made to
collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.expect import row_hash

LANES = ("l0", "l1", "l2", "l3")
MODULUS = "18446744073709551616BD"
#: Rows that a leaf of a tree holds on average, at most.
LEAF = 256


def lanes(digest: Column) -> list[Column]:
    """The four lanes of a hexadecimal SHA-256."""
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(name) for i, name in enumerate(LANES)]


def sums() -> list[Column]:
    """Aggregates that add lanes up."""
    return [F.expr(f"cast(sum(cast({name} as decimal(28,0))) % {MODULUS} as decimal(20,0))").alias(name) for name in LANES]


def digest_text() -> Column:
    """The digest as text: the count, then the lanes."""
    return F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(name).cast("string") for name in LANES])


def multiset_digests(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``by`` columns, n_rows and lanes of each group; of no columns one row, also for an empty table."""
    rows = df.select(*by, row_hash(df, cols).alias("__h")).select(*by, *lanes(F.col("__h")))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sums())
    return out.na.fill(0, list(LANES)) if not by else out


def combined(digests: DataFrame, by: list[str]) -> DataFrame:
    """The digests of unions."""
    return digests.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *sums())


def depth_for(rows: int) -> int:
    """Levels under the root, 16-way, after which a leaf holds no more than ``LEAF`` rows on average."""
    depth = 1
    while LEAF * 16**depth < rows:
        depth += 1
    return depth


def write_tree(df: DataFrame, key: str, cols: list[str], path: str, depth: int) -> None:
    """Stores the hash tree of a table: ``rows`` in folders of the first two digits, sorted by leaf, and ``nodes`` by level.

    A row's leaf is given by the first digits of its key's hash, so that both sides of a
    comparison place a key alike. Rows are hashed once; the levels above follow from the
    leaves. Keys that repeat, also null, share a leaf and count as a multiset.
    """
    placed = F.sha2(F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")), 256)
    rows = df.select(F.col(key).alias("key"), placed.alias("p"), row_hash(df, cols).alias("h"))
    rows = rows.select("key", "h", F.substring("p", 1, depth).alias("leaf"), F.substring("p", 1, 2 if depth > 2 else 1).alias("top"))
    rows.repartitionByRange("leaf", "h").sortWithinPartitions("top", "leaf").write.partitionBy("top").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema("key " + df.schema[key].dataType.simpleString() + ", h string, leaf string, top string").parquet(f"{path}/rows")
    level = stored.select(F.col("leaf").alias("node"), *lanes(F.col("h"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"), *sums())
    level.sort("node").write.parquet(f"{path}/nodes/level={depth}")
    for up in range(depth - 1, -1, -1):
        below = read_nodes(df.sparkSession, path, up + 1)
        combined(below.withColumn("node", F.substring("node", 1, up)), ["node"]).sort("node").write.parquet(f"{path}/nodes/level={up}")


def read_nodes(spark: SparkSession, path: str, level: int) -> DataFrame:
    kinds = ", ".join(f"{name} decimal(20,0)" for name in LANES)
    return spark.read.schema(f"node string, n_rows long, {kinds}").parquet(f"{path}/nodes/level={level}")


def differing_leaves(spark: SparkSession, left: str, right: str, depth: int) -> DataFrame:
    """``node`` of the leaves that differ between two stored trees of one depth.

    The trees are compared from the root; a level is read for the children of nodes that
    differ, and equal trees end at the root.
    """
    state = lambda path, level, side: read_nodes(spark, path, level).select("node", digest_text().alias(side))
    open_ = None
    for level in range(depth + 1):
        a, b = state(left, level, "a"), state(right, level, "b")
        if open_ is not None:
            parents = open_.select(F.col("node").alias("parent"))
            a, b = (s.join(parents, F.substring("node", 1, level - 1) == F.col("parent"), "left_semi") for s in (a, b))
        open_ = a.join(b, "node", "full").where("not a <=> b").select("node")
        if level == 0 and open_.isEmpty():
            return open_
    return open_


def parity_by_descent(spark: SparkSession, left: str, right: str, key: str, key_type: str, depth: int) -> DataFrame:
    """Keys whose rows differ between two stored trees, and how; rows are read only in leaves that differ.

    A key that repeats is changed where its rows are not the same multiset.
    """
    leaves = differing_leaves(spark, left, right, depth)
    leaves = leaves.withColumn("node_top", F.substring("node", 1, 2 if depth > 2 else 1))
    sides = []
    for path, side in ((left, "a"), (right, "b")):
        rows = spark.read.schema(f"key {key_type}, h string, leaf string, top string").parquet(f"{path}/rows")
        rows = rows.join(leaves, (rows["top"] == leaves["node_top"]) & (rows["leaf"] == leaves["node"]), "left_semi")
        one = rows.select("key", *lanes(F.col("h"))).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), *sums())
        sides.append(one.select(F.col("key").alias(f"k{side}"), digest_text().alias(side)))
    kind = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right").otherwise("changed")
    both = sides[0].join(sides[1], F.col("ka").eqNullSafe(F.col("kb")), "full").where("not a <=> b")
    # a null key is told from a missing side by the digest
    return both.select(F.when(F.col("a").isNull(), F.col("kb")).otherwise(F.col("ka")).alias(key), kind.alias("difference"))
