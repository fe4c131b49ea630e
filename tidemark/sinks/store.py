"""Documents stored once under their hash, and snapshots as lists of hashes.

    root/log/00000000000000000002.json    the second folder of documents
    root/docs/folder=<name>/              hash, size, check and body, sorted by hash
    root/snapshots/name=<name>/           owner, position and hash

A snapshot that shares documents with earlier ones adds the others alone. A document is read
by its hash, and what is read is hashed again. Two writers may both store a document that is
new to both; readers see it once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.commits import LOG, Files

STORED = "hash string, size long, check string, body string"


class Collision(Exception):
    """A stored document has the hash of another one."""


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def _folders(self) -> list[str]:
        names = sorted(n for n in self.files.names(f"{self.root}/log") if LOG.match(n))
        return [json.loads(self.files.read(f"{self.root}/log/{n}"))["folder"] for n in names]

    def stored(self) -> DataFrame:
        """``hash, size, check, body`` of all folders."""
        paths = [f"{self.root}/docs/folder={f}" for f in self._folders()]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def put(self, bodies: DataFrame) -> int:
        """Stores the texts of a column ``body`` that are not there yet, and gives their number.

        Texts that are there are compared by size and a second hash, without reading stored
        bodies; where these differ nothing is stored. Null texts are left out.
        """
        new = bodies.where("body is not null").select(F.sha2("body", 256).alias("hash"), F.octet_length("body").cast("long").alias("size"), F.md5("body").alias("check"), "body").dropDuplicates(["hash", "size", "check"])
        known = self.stored().select("hash", F.struct("size", "check").alias("was")).distinct()
        state = new.join(known, "hash", "left")
        folder = uuid.uuid4().hex
        path = f"{self.root}/docs/folder={folder}"
        state.where(F.col("was").isNull() | (F.col("was") != F.struct("size", "check"))).drop("was").repartitionByRange("hash").sortWithinPartitions("hash").write.parquet(path)
        written = self.spark.read.schema(STORED).parquet(path)
        n, hashes, clash = written.join(known.select("hash", F.lit(1).alias("old")), "hash", "left").agg(F.count(F.lit(1)), F.count_distinct("hash"), F.count("old")).first()
        if clash or n != hashes:
            raise Collision(f"{clash + n - hashes} documents")
        while n and not self.files.put_if_absent(f"{self.root}/log/{len(self._folders()) + 1:020d}.json", json.dumps({"folder": folder, "documents": n})):
            pass
        return n

    def snapshot(self, docs: DataFrame, name: str, owner: str, position: str) -> int:
        """Stores the documents of a table (owner, position, body) and their list; the number of documents that were new.

        A name is taken once: the same list again changes nothing, another one is refused.
        """
        lists = docs.select(owner, position, F.sha2("body", 256).alias("hash"))
        path = f"{self.root}/snapshots/name={name}"
        added = self.put(docs.select("body"))
        try:
            lists.write.mode("errorifexists").parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            old = self.spark.read.schema(lists.schema).parquet(path)
            if not (old.exceptAll(lists).isEmpty() and lists.exceptAll(old).isEmpty()):
                raise ValueError(f"snapshot {name} holds another list") from e
        return added

    def lists(self, name: str, schema: str) -> DataFrame:
        """The rows of a snapshot: owner, position, hash."""
        return self.spark.read.schema(f"{schema}, hash string").parquet(f"{self.root}/snapshots/name={name}")

    def identities(self, name: str, schema: str, owner: str, position: str) -> DataFrame:
        """Per owner, the hash of its list of hashes; owners must be bounded."""
        rows = self.lists(name, schema).groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(position, "hash"))).alias("h"))
        return rows.select(owner, F.size("h").cast("long").alias("n"), F.sha2(F.array_join(F.transform("h", lambda x: F.coalesce(x["hash"], F.lit(""))), "\n"), 256).alias("sha256"))

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of a snapshot with ``body`` and ``fault``: missing, or changed where the body has another hash; null texts have neither."""
        one = self.stored().dropDuplicates(["hash", "size", "check"]).select("hash", "body")
        fault = F.when(F.col("hash").isNotNull() & F.col("body").isNull(), "missing").when(F.sha2("body", 256) != F.col("hash"), "changed")
        return self.lists(name, schema).join(one, "hash", "left").withColumn("fault", fault)
