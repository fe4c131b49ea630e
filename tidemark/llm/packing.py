"""Optimal length buckets.

A dynamic program over the global histogram of lengths chooses bucket bounds that
minimise padding, and batches within a token budget form inside each bucket. Only
the histogram reaches the driver: k distinct lengths need k * (k + 1) / 2 tokens of
input, so its size is bounded by the square root of twice the corpus. Rows are
numbered inside a bucket by ordered hash cells, so a bucket with a third of all
rows is ranked by many tasks.

Defined results: a null or empty text has length 0 and falls in the first bucket;
a document longer than the budget is a batch of its own; repeated rows take slots
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, bucket_of, long_array, text_of, with_slots, words_of

CELL_ROWS = 50_000


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``cost(i, j)`` pads lengths i..j-1 to the longest of them. It has the Monge
    property, so each layer is solved by divide and conquer over the split points.
    """
    lengths = np.array([x for x, _ in sorted(histogram)], dtype=np.int64)
    counts = np.array([c for _, c in sorted(histogram)], dtype=np.int64)
    d = len(lengths)
    if not d:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = lambda i, j: lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
    layer = np.array([0] + [cost(0, j) for j in range(1, d + 1)], dtype=np.int64)
    splits = []
    for _ in range(1, min(buckets, d)):
        nxt, split = layer.copy(), np.zeros(d + 1, dtype=np.int64)
        todo = [(1, d, 0, d - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            values = layer[i] + cost(i, mid)
            at = int(np.argmin(values))
            nxt[mid], split[mid] = values[at], i[at]
            todo += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        splits.append(split)
        layer = nxt
    bounds, j = [], d
    for split in reversed(splits):
        bounds.append(int(lengths[j - 1]))
        j = int(split[j])
        if not j:
            break
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(bounds)


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, seed: int = 0, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, bucket, bucket_len, batch, slot, padding`` for every row.

    ``length`` counts tokens; the default counts words. Inside a bucket rows are in
    the order of a seeded hash, and a batch holds ``budget // bucket_len`` rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    text = text_of(docs, text_col)
    tokens = (F.size(words_of(text)) if length is None else length).cast("long")
    rows = space.save(docs.select(docs[id_col].alias(id_col), tokens.alias("n_tokens"), F.xxhash64(F.lit(seed), docs[id_col], text).alias("h")), "rows")
    histogram = [(r.n_tokens, r.n) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = best_bounds(histogram, buckets)
    parts = max(64, -(-sum(c for _, c in histogram) // CELL_ROWS))
    cell = F.shiftright("h", 64 - (parts - 1).bit_length())  # the sign stays, so cells keep the order of h
    # written, for numbering reads it twice, and the optimizer may otherwise mix up the two copies of the search
    rows = space.save(rows.withColumn("bucket", bucket_of(F.col("n_tokens"), bounds).cast("int")).withColumn("cell", cell), "placed")
    space.drop("rows")
    bound = F.get(long_array(bounds or [0]), F.col("bucket"))
    rows = with_slots(rows, ["bucket"], "cell", ["h", id_col], "slot").withColumn("bucket_len", bound)
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return rows.select(id_col, "n_tokens", "bucket", "bucket_len", F.floor(F.col("slot") / per_batch).cast("long").alias("batch"), "slot", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Query: bucket, batch and padding of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
