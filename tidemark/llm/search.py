"""Ranked lexical search over document-sharded postings in compressed sparse rows.

``build_index`` tokenises whole texts in tasks and writes shards: a shard holds at most
SHARD_DOCS documents, or SHARD_POSTINGS postings and one document more, as arrays of a
row: ids and lengths of its documents, and by term the document numbers and term counts,
term after term, with the offsets of the terms. Terms that no query asks for are left out
where ``terms`` is given, but still count for the lengths of documents.

``search`` first adds up the document frequencies. Then each shard turns all its postings
into integer impacts at once, by the lengths of its documents, and answers the queries one
after another, term at a time: the impacts of a term, times its weight, are added to one
dense array of scores. The best k are cut off by argpartition: all documents above the
k-th score stay, and of those equal to it the ones of smallest id. A task carries the best
k of each query from shard to shard, so that its result grows with the queries, not with
its shards; the tasks' results are merged by rank.

Queries are asked in blocks of at most BLOCK_TERMS different terms, so what a task holds
of them is bounded; every block runs against all documents.

Score: with N documents that have a term, L terms of all of them, n terms of the document,
df documents that hold the term and tf its occurrences in the document, a term weighs
floor(1000 ln((2N + 2) / (2df + 1))), and adds that times (10^9 tf) div (1000 tf + 20 m)
to the score, where m = 50 + (50 n N) div L. All but the logarithm is 64-bit integer.

Defined results: a null or empty text has no terms and is never found; a query without
terms, or whose terms no document holds, has no rows; queries that share an id are one
with the terms of all their texts, those without an id are one as well; rows that share a
doc_id are documents of their own; of equal scores the smallest id ranks first, no id
last; the longest text is read whole; an empty table on either side gives no rows.
Columns other than the ids and texts are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, text_of

K = 50
SHARD_DOCS = 16384
SHARD_POSTINGS = 2**20
BLOCK_TERMS = 2**17
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARD = "docs array<long>, lengths array<int>, terms array<int>, starts array<int>, numbers array<int>, counts array<int>"
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """Terms in UTF-8; lowering bytes touches A-Z alone."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class _Shard:
    """Collects the documents of one shard."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, length: int, ids: np.ndarray) -> None:
        terms, counts = np.unique(ids, return_counts=True)
        self.docs.append(NO_ID if doc is None else doc)
        self.lengths.append(length)
        self.terms.append(terms)
        self.counts.append(counts)
        self.held += len(terms)

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or self.held >= SHARD_POSTINGS

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """The shard as one row, postings in order of term and document number."""
        numbers = np.repeat(np.arange(len(self.docs), dtype=np.int32), [len(t) for t in self.terms])
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        order = np.argsort(terms, kind="stable")
        present, starts = np.unique(terms[order], return_index=True)
        row = (self.docs, self.lengths, present, np.append(starts, len(terms)), numbers[order], counts[order])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def build_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the postings of ``terms``, which gives each term its number; documents without any term are left out."""
    schema = pa.schema([pa.field(n, pa.list_(pa.int64() if n == "docs" else pa.int32())) for n in ("docs", "lengths", "terms", "starts", "numbers", "counts")])
    held = docs.sparkSession.sparkContext.broadcast(terms)  # at most BLOCK_TERMS terms

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = held.value.get, _Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                ids = np.fromiter((i for i in map(number, found) if i is not None), np.int32)
                shard.add(doc, len(found), ids)
                if shard.full():
                    yield shard.batch(schema)
                    shard = _Shard()
        if shard.docs:
            yield shard.batch(schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text")).mapInArrow(shards, SHARD)


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer impact of each posting, without the weight of its term."""
    m = 100 - 50 + (50 * lengths.astype(np.int64) * n_docs) // n_terms
    tf = counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, of equal scores those with the smallest ids."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        kth = scores[at][np.argpartition(scores[at], len(at) - k)[len(at) - k]]
        above, level = at[scores[at] > kth], at[scores[at] == kth]
        left = k - len(above)
        if len(level) > left:
            level = level[np.argpartition(docs[level], left - 1)[:left]]
        at = np.concatenate([above, level])
    return at


def search(index: DataFrame, queries: list[tuple[int, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``query, id, score``: for every query the best k of each task's shards.

    ``queries`` holds a number and term numbers each; ``weights`` the weight by term number.
    """
    schema = pa.schema([("query", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
    asked = index.sparkSession.sparkContext.broadcast((queries, weights))  # at most BLOCK_TERMS terms

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = asked.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths, terms, starts, numbers, counts = (batch.column(c)[row].values.to_numpy() for c in range(6))
                impact = impacts(counts, lengths[numbers], n_docs, n_terms)
                spans = {t: (a, b) for t, a, b in zip(terms.tolist(), starts[:-1].tolist(), starts[1:].tolist())}
                for query, asked_terms in queries:
                    scores = np.zeros(len(docs), np.int64)
                    for t in asked_terms:
                        if t in spans:
                            a, b = spans[t]
                            scores[numbers[a:b]] += weights[t] * impact[a:b]
                    at = best(scores, docs, k)
                    if len(at):
                        ids, sums = docs[at], scores[at]
                        if query in kept:
                            ids, sums = np.concatenate([kept[query][0], ids]), np.concatenate([kept[query][1], sums])
                            at = best(sums, ids, k)
                            ids, sums = ids[at], sums[at]
                        kept[query] = ids, sums
        for query, (ids, sums) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query, np.int32)), pa.array(ids), pa.array(sums)], schema=schema)

    return index.mapInArrow(answers, "query int, id long, score long")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query (number from 0), id, term``: the distinct terms of every query."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(terms_of(text))
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(terms, pa.binary())], names=["id", "term"])

    rows = queries.select(F.col(id_col).alias("id"), text_of(queries, text_col).alias("text"))
    return rows.mapInArrow(split, f"id {rows.schema['id'].dataType.simpleString()}, term binary").distinct()


def blocks_of(terms: DataFrame, space: Workspace, most: int) -> list[DataFrame]:
    """Queries in blocks of at most ``most`` terms, or one query: equal ranges of the hash of the id, halved where they hold more.

    Every block is ``id, term``; what the driver sees is one count a block.
    """
    rows = space.save(terms.withColumn("h", F.xxhash64("id")), "asked")
    open_, done = [(-(2**63), 2**63 - 1)], []
    while open_:
        lo, hi = open_.pop()
        part = rows.where(F.col("h").between(lo, hi))
        n, ids = part.agg(F.count(F.lit(1)), F.count_distinct("h")).first()
        if n > most and ids > 1:
            middle = (lo + hi) // 2
            open_ += [(lo, middle), (middle + 1, hi)]
        elif n:
            done.append(part.select("id", "term"))
    return done


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``query_col, rank, id_col, score``: for every query its ``k`` documents of highest score above 0."""
    spark = docs.sparkSession
    space, out = Workspace(spark, "search"), None
    for b, block in enumerate(blocks_of(query_terms(queries, query_col, query_text_col), space, block_terms)):
        ids: dict[object, int] = {}
        numbers: dict[bytes, int] = {}
        asked: dict[int, list[int]] = {}
        for i, term in block.collect():  # at most BLOCK_TERMS rows, or those of one query
            asked.setdefault(ids.setdefault(i, len(ids)), []).append(numbers.setdefault(bytes(term), len(numbers)))
        index = space.save(build_index(docs, numbers, id_col, text_col), f"index{b}")
        n_docs, n_terms = index.agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x))).first()
        if not n_docs:
            continue
        held = index.select(F.explode(F.arrays_zip("terms", F.slice("starts", 1, F.size("terms")).alias("a"), F.slice("starts", 2, F.size("terms")).alias("b"))).alias("t"))
        weight = F.floor(F.log((2 * F.lit(n_docs) + 2) / (2 * F.sum(F.col("t.b") - F.col("t.a")) + 1)) * 1000)
        weights = np.zeros(len(numbers), np.int64)
        for t, w in held.groupBy("t.terms").agg(weight.alias("w")).collect():  # at most BLOCK_TERMS rows
            weights[t] = w
        found = search(index, list(asked.items()), weights, int(n_docs), int(n_terms), k)
        names = spark.createDataFrame([(n, i) for i, n in ids.items()], f"query int, __query {dict(queries.dtypes)[query_col]}")
        found = found.join(names, "query").drop("query")
        out = found if out is None else out.unionAll(found)
    kind = dict(queries.dtypes)[query_col]
    if out is None:
        return spark.createDataFrame([], f"{query_col} {kind}, rank int, {id_col} long, score long")
    order = Window.partitionBy("__query").orderBy(F.col("score").desc(), "id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("__query").alias(query_col), "rank", F.when(F.col("id") != int(NO_ID), F.col("id")).alias(id_col), "score")


def op12_search(spark, sf_dir: str) -> DataFrame:
    """Query: the 50 documents of highest score for every benchmark item, over all documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, items)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY t, nd),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT q.item_id, d.doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * nd) // l))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN d USING (r), g GROUP BY q.item_id, d.doc_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
