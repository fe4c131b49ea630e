"""A table that only grows, whose digest grows with it.

    root/log/00000000000000000003.json    the fourth append: name, folder, rows, digest, digest of the whole table
    root/data/folder=<name>/              its rows

An append has a name. Repeating it with the same rows changes nothing, and with other rows it
is refused. Its rows are hashed once, when they have been written; the digest of the table is
the old one plus that of the rows, so that nobody reads old rows to extend it. A check of the
whole table reads every row once, and names the append whose rows are no more what they were.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.multiset import LANES, multiset_digests
from tidemark.sinks.commits import LOG, Files

Digest = tuple[int, ...]
#: The digest of no rows.
NONE: Digest = (0,) * (1 + len(LANES))


def of(row: Row) -> Digest:
    return (row.n_rows, *[int(row[name]) for name in LANES])


def plus(a: Digest, b: Digest) -> Digest:
    return (a[0] + b[0], *[(x + y) % 2**64 for x, y in zip(a[1:], b[1:], strict=True)])


@dataclass(frozen=True)
class Append:
    name: str
    folder: str
    digest: Digest
    total: Digest


class AppendLog:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema
        self.columns = StructType.fromDDL(schema).names
        self.files = Files(spark, root)

    def appends(self) -> list[Append]:
        names = sorted(n for n in self.files.names(f"{self.root}/log") if LOG.match(n))
        read = (json.loads(self.files.read(f"{self.root}/log/{n}")) for n in names)
        return [Append(r["name"], r["folder"], tuple(r["digest"]), tuple(r["total"])) for r in read]

    def _digest(self, df: DataFrame) -> Digest:
        return of(multiset_digests(df.select(*self.columns), self.columns, []).first())

    def _folder(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data/folder={folder}")

    def append(self, df: DataFrame, name: str) -> bool:
        """Adds rows under a name; False where that append is in the log already.

        Of several writers one gets the next place, and the others try the one after it. What
        a writer leaves that never got a place is not read.
        """
        folder = uuid.uuid4().hex
        df.select(*self.columns).write.parquet(f"{self.root}/data/folder={folder}")
        digest = self._digest(self._folder(folder))
        while True:
            log = self.appends()
            same = [a for a in log if a.name == name]
            if same:
                if same[0].digest != digest:
                    raise ValueError(f"append {name} is in the log with other rows")
                return False
            new = Append(name, folder, digest, plus(log[-1].total if log else NONE, digest))
            if self.files.put_if_absent(f"{self.root}/log/{len(log):020d}.json", json.dumps(asdict(new))):
                return True

    def read(self) -> DataFrame:
        """The rows of all appends."""
        paths = [f"{self.root}/data/folder={a.folder}" for a in self.appends()]
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def broken_links(self) -> list[str]:
        """Appends whose total is not that of the one before plus their own rows; reads the log alone."""
        total, broken = NONE, []
        for a in self.appends():
            if a.total != plus(total, a.digest):
                broken.append(a.name)
            total = a.total
        return broken

    def proof(self) -> DataFrame:
        """``name, expected, rows, status`` of each append: same, changed, removed or repeated, by one scan of the rows."""
        log = self.appends()
        listed = self.spark.createDataFrame([(a.name, a.folder, a.digest[0], ":".join(map(str, a.digest))) for a in log], "name string, folder string, expected long, digest string")
        rows = self.spark.read.schema(f"{self.schema}, folder string").option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/folder={a.folder}" for a in log]) if log else self.spark.createDataFrame([], f"{self.schema}, folder string")
        now = multiset_digests(rows, self.columns, ["folder"]).select("folder", F.col("n_rows").alias("rows"), F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(c).cast("string") for c in LANES]).alias("now"))
        n = F.coalesce("rows", F.lit(0).cast("long"))
        status = F.when((n == 0) & (F.col("expected") == 0) | (F.col("now") == F.col("digest")), "same").when(n < F.col("expected"), "removed").when(n > F.col("expected"), "repeated").otherwise("changed")
        return listed.join(now, "folder", "left").select("name", "expected", n.alias("rows"), status.alias("status"))
