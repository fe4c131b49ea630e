"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are runs of at most 6 letters, digits or marks in lower case. Every k = 4
consecutive tokens give a gram hash; in every window of w = 4 consecutive grams the
least hash is chosen, the rightmost of equal ones. Chosen grams keep their position,
so two texts that share k + w - 1 = 7 consecutive tokens are sure to share a gram.
Hash and position are packed in one long, high bits first, with the position counted
down: the least long of a window is the least hash, rightmost on a tie.

A token is hashed once. A gram's hash is the polynomial of its token hashes, which is
rolled over the text in two sweeps that combine neighbours: tokens to pairs, and pairs
to grams of four, since a scan that carries a value along cannot be a column function
of bounded cost. A text of fewer than w grams is one window.

All of it happens inside the row. The query's next document is found in ordered
ranges of doc_id; the head of each range is copied to the end of the range before
it, so no window spans more than one range.

Defined results: a null text counts as empty; a text of fewer than k tokens is one
gram, a text without tokens but with other characters is one gram of the text, an
empty text has none; two empty fingerprints have likeness 1, an empty and another
one 0. The longest text is fingerprinted whole; an empty table gives an empty result.
In the query rows that share a doc_id follow each other by text, null doc_ids come
last, and rows of one doc_id, or of none, are ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import bucket_of, long_array, range_edges, task_count, text_of

TOKEN = "[\\p{L}\\p{M}\\p{N}_]{1,6}"
K = 4
W = 4
#: Gram hashes are polynomials of the token hashes in BASE modulo PRIME.
PRIME = 2**31 - 1
BASE = 1_103_515_245
LAST = 2**31 - 1


def with_grams(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the chosen grams of a text column as packed longs in order of position."""
    tokens, numbers, twos, fours, grams, pairs = (f"{name}_{x}" for x in ("t", "h", "h2", "h4", "g", "g2"))
    df = df.withColumn(tokens, F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(numbers, F.transform(tokens, lambda x: F.pmod(F.hash(x).cast("long"), F.lit(PRIME))))
    h, n = F.col(numbers), F.size(numbers)
    rolled = lambda a, step, count, power: F.zip_with(F.slice(a, 1, count), F.slice(a, 1 + step, count), lambda x, y: (x * power + y) % PRIME)
    df = df.withColumn(twos, F.when(n >= K, rolled(h, 1, n - 1, BASE)))
    df = df.withColumn(fours, F.when(n >= K, rolled(F.col(twos), 2, n - 3, BASE * BASE % PRIME)))
    packed = lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(LAST) - i)
    few = F.aggregate(h, F.lit(0).cast("long"), lambda held, x: (held * BASE + x) % PRIME)
    zero = F.lit(0).cast("long")
    df = df.withColumn(grams, F.when(n >= K, F.transform(fours, packed)).when(n > 0, F.array(packed(few, zero))).when(F.length(text) > 0, F.array(packed(F.pmod(F.hash(text).cast("long"), F.lit(PRIME)), zero))).otherwise(F.array().cast("array<bigint>")))
    g, m = F.col(grams), F.size(grams)
    df = df.withColumn(pairs, F.when(m >= W, F.zip_with(F.slice(g, 1, m - 1), F.slice(g, 2, m - 1), lambda x, y: F.least(x, y))))
    p = F.col(pairs)
    least = F.zip_with(F.slice(p, 1, m - 3), F.slice(p, 3, m - 3), lambda x, y: F.least(x, y))
    df = df.withColumn(name, F.when(m >= W, F.array_distinct(least)).when(m > 0, F.array(F.array_min(g))).otherwise(g))
    return df.drop(tokens, numbers, twos, fours, grams, pairs)


def fingerprint_string(chosen: Column) -> Column:
    """``hash:position`` of each chosen gram, comma-joined."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def gram_hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of gram hashes."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (string) and ``grams`` (array of structs of hash and position)."""
    own = [c for c in docs.columns if c not in ("fingerprint", "grams")]
    df = with_grams(docs.withColumn("__text", text_of(docs, text_col)), "__text", "__fp")
    return df.select(*own, fingerprint_string(F.col("__fp")).alias("fingerprint"), F.transform("__fp", lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).alias("position"))).alias("grams"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, bucket, ghost`` in ranges; ghosts are the rows that follow a range."""
    n = docs.select("doc_id").count()
    ranges = range_edges(docs, "doc_id", max(1, -(-n // (8 * task_count(docs.sparkSession)))))
    uppers, heads = [r.upper for r in ranges], [r.top for r in ranges]
    bucket = bucket_of(F.col("doc_id"), uppers).cast("int")
    rows = docs.select("doc_id", "text").withColumn("bucket", bucket)
    last = max(len(ranges) - 1, 0)
    head = F.coalesce(F.get(long_array(heads), bucket_of(F.col("doc_id"), heads).cast("int")) == F.col("doc_id"), F.lit(False)) if heads else F.lit(True)
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g"))
    follows = F.when(F.col("bucket") == last, F.lit(0)).otherwise(F.col("bucket") + 1)
    copies = F.when(head, F.array(own, F.struct(follows.alias("b"), F.lit(True).alias("g")))).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", F.col("c.b").alias("bucket"), F.col("c.g").alias("ghost"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every document and of its edited text, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = with_next(docs).repartition(task_count(spark), "bucket")
    rows = with_grams(rows, "text", "fp")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).where("not ghost")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.coalesce("next_text", "text"), F.lit(1), third)))
    rows = with_grams(rows, "edited", "efp")
    rows = rows.withColumns({"ha": gram_hashes(F.col("fp")), "hb": gram_hashes(F.col("efp")), "hn": gram_hashes(F.coalesce("next_fp", "fp"))})
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_string(F.col("fp")).alias("fingerprint"),
        fingerprint_string(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("ha"), F.col("hb")).alias("near_edited"),
        likeness(F.col("ha"), F.col("hn")).alias("near_next"),
    )
