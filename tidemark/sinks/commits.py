"""A table of keyed rows with several writers: an optimistic commit log over Parquet.

    root/log/00000000000000000007.json    manifest of version 7
    root/data/folder=<name>/              rows that the commit put or deleted
    root/keys/folder=<name>/              keys that it touched, sorted

A writer begins at a version, stages rows and keys, and commits by putting the manifest of
the next version, which only one writer can. A loser reads what was committed since it
began: where the keys are apart its change is rebased on the new head, where they overlap
it is a conflict and nothing of it is seen. Conflicts are never retried by the table, for
the change was made for rows that are no more. Keys that a decision was based on without
being written may be given as well and count as touched when the writer commits.

A reader pins a version: it reads the commits that manifests up to that version name, so
what others commit meanwhile, or stage and abandon, is not seen. A commit with an id that
is in the log already changes nothing and gives its version, so that repeating it is safe.

``compact`` writes the rows of a version as one base, from which later readers start;
versions before it remain readable, for no file is ever changed.

Everything that grows with the rows is a Spark job; the driver sees one manifest for each
commit since the last base.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = re.compile(r"^(\d{20})\.json$")


class Conflict(Exception):
    """Another commit touched keys of this one since it began; ``keys`` are the first of them in order."""

    def __init__(self, version: int, keys: list):
        super().__init__(f"keys {keys} were changed by version {version}")
        self.version, self.keys = version, keys


@dataclass(frozen=True)
class Manifest:
    """``folder`` holds the rows; ``low`` and ``high`` bound the touched keys, as text of their JSON, null for none."""

    version: int
    commit: str
    folder: str
    read: int
    rows: int
    low: str | None
    high: str | None
    base: bool = False


class Files:
    """The few file operations of the log, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, path: str, text: str) -> bool:
        """Writes a whole file under a name that is not taken; of several writers one gets it.

        A temporary file is linked, on a local or mounted folder, or renamed without
        overwriting, which file systems of a cluster do atomically.
        """
        temporary = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        self.fs.mkdirs(temporary.getParent())
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                local = lambda p: self.jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString()
                os.link(local(temporary), local(self._path(path)))
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.jvm.java.lang.reflect.Array.newInstance(rename.getClass(), 1)
                options[0] = rename
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(temporary, self._path(path), options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            self.fs.delete(temporary, False)


class CommitTable:
    """A table whose rows have one key column; ``schema`` is the DDL of all its columns."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.files = Files(spark, self.root)
        self.stored = f"{schema}, __deleted boolean, folder string"

    def head(self) -> int:
        """The newest version; 0 is the empty table."""
        return max((int(m[1]) for n in self.files.names(f"{self.root}/log") if (m := LOG.match(n))), default=0)

    def manifest(self, version: int) -> Manifest:
        return Manifest(**json.loads(self.files.read(f"{self.root}/log/{version:020d}.json")))

    def history(self, version: int, after: int = 0) -> list[Manifest]:
        return [self.manifest(v) for v in range(after + 1, version + 1)]

    def _since_base(self, version: int) -> list[Manifest]:
        out: list[Manifest] = []
        for v in range(version, 0, -1):
            out.append(self.manifest(v))
            if out[-1].base:
                break
        return out[::-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default, with ``__version``, by which each was written."""
        version = self.head() if version is None else version
        commits = [m for m in self._since_base(version) if m.rows]
        if not commits:
            return self.spark.createDataFrame([], f"{self.schema}, __version long")
        paths = [f"{self.root}/data/folder={m.folder}" for m in commits]
        rows = self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(*paths)
        numbers = self.spark.createDataFrame([(m.folder, m.version) for m in commits], "folder string, __number long")
        kept = [c for c in rows.columns if c not in ("folder", "__deleted", self.key)]
        rows = rows.join(F.broadcast(numbers), "folder")  # a row for each commit since the base
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*kept, "__deleted", "__number"), "__number").alias("x")).where("not x.__deleted")
        return last.select(*[F.col(c) if c == self.key else F.col(f"x.{c}") for c in self.columns()], F.col("x.__number").alias("__version"))

    def columns(self) -> list[str]:
        return [c for c in self.spark.createDataFrame([], self.schema).columns]

    def begin(self, version: int | None = None) -> Transaction:
        return Transaction(self, self.head() if version is None else version)

    def find(self, commit: str) -> int | None:
        """The version of a commit; a base does not hide those before it."""
        for v in range(self.head(), 0, -1):
            if self.manifest(v).commit == commit:
                return v
        return None

    def compact(self) -> int:
        """Writes the rows of the head as a base; it touches no keys, so it never conflicts."""
        version = self.head()
        folder = uuid.uuid4().hex
        self.read(version).drop("__version").withColumn("__deleted", F.lit(False)).write.parquet(f"{self.root}/data/folder={folder}")
        rows = self.spark.read.schema(self.stored).parquet(f"{self.root}/data/folder={folder}").count()
        taken = self._put(Manifest(version + 1, f"base-{folder}", folder, version, rows, None, None, True))
        return version + 1 if taken else self.compact()  # what came between must be in the base

    def _put(self, m: Manifest) -> bool:
        return self.files.put_if_absent(f"{self.root}/log/{m.version:020d}.json", json.dumps(asdict(m), sort_keys=True))

    def touched(self, m: Manifest) -> DataFrame:
        kind = next(f for f in self.spark.createDataFrame([], self.schema).schema if f.name == self.key).dataType.simpleString()
        return self.spark.read.schema(f"{self.key} {kind}").parquet(f"{self.root}/keys/folder={m.folder}")


class Transaction:
    """Changes made for the rows of one version."""

    def __init__(self, table: CommitTable, version: int):
        self.table, self.version = table, version
        self.changes: list[DataFrame] = []

    def read(self) -> DataFrame:
        return self.table.read(self.version)

    def put(self, rows: DataFrame) -> Transaction:
        """Rows that are new or replace those of the same keys."""
        self.changes.append(rows.select(*self.table.columns()).withColumn("__deleted", F.lit(False)))
        return self

    def delete(self, keys: DataFrame) -> Transaction:
        kinds = self.table.spark.createDataFrame([], self.table.schema).schema
        empty = [F.col(f.name) if f.name == self.table.key else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds]
        self.changes.append(keys.select(*empty).withColumn("__deleted", F.lit(True)))
        return self

    def commit(self, commit: str | None = None, read_keys: DataFrame | None = None) -> int:
        """The version that the changes became; raises Conflict where another commit came between.

        A key may be changed once; null keys are refused.
        """
        t, key = self.table, self.table.key
        if commit is not None and (known := t.find(commit)) is not None:
            return known
        folder = uuid.uuid4().hex  # an attempt that failed leaves its own, which no manifest names
        commit = commit or folder
        rows = self.changes[0]
        for more in self.changes[1:]:
            rows = rows.unionByName(more)
        rows.write.parquet(f"{t.root}/data/folder={folder}")
        rows = t.spark.read.schema(t.stored).parquet(f"{t.root}/data/folder={folder}")
        n, null, twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count_if(F.col(key).isNull()), F.count_if(F.col("n") > 1)).first()
        if null or twice:
            raise ValueError(f"{twice} keys are changed twice, {null} are null")
        rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(key).write.parquet(f"{t.root}/keys/folder={folder}")
        low, high = rows.agg(F.to_json(F.struct(F.min(key).alias("k"))), F.to_json(F.struct(F.max(key).alias("k")))).first()
        own = Manifest(0, commit, folder, self.version, n or 0, low if n else None, high if n else None)
        mine = t.touched(own)
        if read_keys is not None:
            mine = mine.unionByName(read_keys.select(key)).distinct()
        seen = self.version
        while True:
            head = t.head()
            for other in t.history(head, seen):
                if other.low is None or (read_keys is None and _apart(own, other)):
                    continue
                shared = [r[0] for r in mine.join(t.touched(other), key, "left_semi").orderBy(key).limit(10).collect()]
                if shared:
                    raise Conflict(other.version, shared)
            seen = head
            if t._put(replace(own, version=head + 1)):
                return head + 1


def _apart(a: Manifest, b: Manifest) -> bool:
    """True where the key ranges show that no key is shared; numbers alone are compared, other keys are joined."""
    if None in (a.low, a.high, b.low, b.high):
        return True
    bounds = [json.loads(x)["k"] for x in (a.low, a.high, b.low, b.high)]
    return all(isinstance(x, int) for x in bounds) and (bounds[1] < bounds[2] or bounds[3] < bounds[0])
