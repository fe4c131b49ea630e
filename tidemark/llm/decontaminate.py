"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words of documents and items are lower-cased in A-Z and compared as they are. Every k = 4
consecutive words give a gram hash; of each n - k + 1 = 7 consecutive grams the least one,
the rightmost of equal ones, is a fingerprint of the text. A span of n = 10 words that a
document and an item share holds the same 7 grams in both, so both keep the same gram at
the same place of the span: every shared span of n words is found through a shared
fingerprint. An item of fewer words is one window of its own length; for each such length
that occurs the documents are winnowed once more with n set to it, so the guarantee holds
for it as well.

1. Inside the row a document's grams are rolled and winnowed. Fingerprints that cannot be
   an item's are dropped by a bitmap of the items' fingerprints, a constant of BITS bits
   however many items there are. It only saves work: what passes by chance goes next.
2. Kept fingerprints, with the words around them, are joined to the distinct fingerprints
   of the items.
3. A hit is extended: the n - k + 1 windows of n words that hold the gram are compared,
   as words, with the distinct windows of the items. A window meets one row at most, so no
   pairs arise inside a gram that many items and many documents hold.
4. Windows of a text are united to spans of words. Windows of items that occur in the same
   items form one class, and texts that meet the same classes are listed once.

Equal texts are worked out once, known by a hash of 128 bits of the text; all tables after
the first step hold only what the bitmap let through.

Defined results: a null or empty text, and an item without words, has no words and meets
nothing; an item without words, or without an id, is in no list, but the words of one
without an id are found; items that share an id are one item with several texts; repeated
documents have equal results; the longest text is read whole; an empty table on either
side gives no hits. Columns of ``docs`` other than the id and the text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, long_array, text_of

N = 10
K = 4
#: Bits of the bitmap of fingerprints.
BITS = 2**20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Gram hashes are polynomials of the word hashes in BASE modulo PRIME.
PRIME = 2**31 - 1
BASE = 1_103_515_245
LAST = 2**31 - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def keys_of(text: Column) -> Column:
    """The words with letters of all scripts lower-cased, which is much faster than A-Z alone.

    As many words at the same places as ``words_of``, and equal words have equal keys, so
    they serve for fingerprints. A capital sigma is settled first, for its lower case
    depends on what follows the word.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))), BETWEEN), "")


def _paired(a: Column, step: int, f) -> Column:
    """``f`` of each element and the one ``step`` later."""
    count = F.size(a) - step
    return F.zip_with(F.slice(a, 1, count), F.slice(a, 1 + step, count), f)


def with_fingerprints(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """Adds ``name``: the fingerprints of windows of ``n`` words, hash and place packed in one long.

    The place is counted down, so the least long of a window is its least hash, rightmost
    on a tie. A text of fewer words has none.
    """
    k = min(K, n)
    enough, at, step = F.size(words) >= n, f"{name}_g1", 1
    df = df.withColumn(at, F.when(enough, F.transform(words, lambda x: F.pmod(F.hash(x).cast("long"), F.lit(PRIME)))))
    made = [at]
    while step < k:  # grams of 2 and 4 words; one of 3 is two of 2 that overlap
        move, at = min(step, k - step), f"{name}_g{step + min(step, k - step)}"
        power = pow(BASE, move, PRIME)
        df = df.withColumn(at, F.when(enough, _paired(F.col(made[-1]), move, lambda x, y: (x * F.lit(power) + y) % PRIME)))
        made.append(at)
        step += move
    at, width, reach = f"{name}_m1", n - k + 1, 1
    df = df.withColumn(at, F.when(enough, F.transform(made[-1], lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(LAST) - i))))
    made.append(at)
    while reach < width:
        move, at = min(reach, width - reach), f"{name}_m{reach + min(reach, width - reach)}"
        df = df.withColumn(at, F.when(enough, _paired(F.col(made[-1]), move, lambda x, y: F.least(x, y))))
        made.append(at)
        reach += move
    return df.withColumn(name, F.coalesce(F.array_distinct(F.col(made[-1])), F.array().cast("array<bigint>"))).drop(*made)


def gram_of(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def place_of(packed: Column) -> Column:
    """Index of a fingerprint's first word, from 0."""
    return (F.lit(LAST) - packed.bitwiseAND(F.lit(LAST))).cast("int")


def item_words(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``item (string), size, w, keys``: the words of the items that have any, and the size of their windows."""
    text = text_of(items, text_col)
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(text).alias("w"), keys_of(text).alias("keys"))
    return rows.select("item", F.least(F.lit(n), F.size("w")).alias("size"), "w", "keys").where("size > 0")


def item_windows(words: DataFrame) -> DataFrame:
    """``item, window``: the distinct windows of the items, words joined by a space."""
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("s")
    return words.select("item", "size", "w", starts).select("item", F.array_join(F.slice("w", F.col("s"), F.col("size")), " ").alias("window")).distinct()


def _bitmap(grams: DataFrame) -> Column:
    """The bitmap of the column ``gram`` as one constant array of BITS / 64 longs."""
    words = grams.select((F.col("gram") % BITS).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    held = [0] * (BITS // 64)
    for i, v in words.collect():  # BITS / 64 rows at most
        held[i] = v
    return long_array(held)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N) -> DataFrame:
    """Per document: id, ``n_words``, ``spans`` (array of structs of first word and end, from 0), ``items`` (sorted ids as strings).

    Spans are the words inside any occurrence of a window of the items, apart from each
    other and in order; ``items`` are those a window of which occurs. Both are empty for
    clean documents.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    own = space.save(item_words(items, item_col, item_text_col, n), "items")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # n values at most
    grams = {}
    for size in sizes:
        marks = space.save(with_fingerprints(own.where(F.col("size") == size), "keys", size, "marks").select("marks"), f"marks{size}")
        grams[size] = space.save(marks.select(F.explode("marks").alias("m")).select(gram_of(F.col("m")).alias("gram")).distinct(), f"grams{size}")

    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.select("id", "text", keys_of(F.col("text")).alias("keys"))
    kept = F.array().cast("array<struct<size:int,gram:bigint,place:int>>")
    for size in sizes:
        rows = with_fingerprints(rows, "keys", size, f"__fp{size}")
        bits = _bitmap(grams[size])
        passes = lambda x: F.getbit(F.get(bits, F.shiftright(x, 37).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int")), F.shiftright(x, 31).bitwiseAND(F.lit(63)).cast("int")) == 1  # noqa: B023, E731
        hit = lambda x: F.struct(F.lit(size).alias("size"), gram_of(x).alias("gram"), place_of(x).alias("place"))  # noqa: B023, E731
        kept = F.concat(kept, F.transform(F.filter(f"__fp{size}", passes), hit))
    rows = rows.select("id", "text", F.size("keys").alias("n_words"), kept.alias("kept"))

    def around(x: Column, w: Column) -> Column:
        """A fingerprint and the words of all windows that hold it."""
        start = F.greatest(x["place"] - x["size"] + F.least(F.lit(K), x["size"]), F.lit(0))
        return F.struct(x["size"].alias("size"), x["gram"].alias("gram"), x["place"].alias("place"), start.alias("start"), F.slice(w, start + 1, x["place"] - start + x["size"]).alias("words"))

    # the words are an array's only element, so that they are made once a text and not once a hit
    hits = F.get(F.transform(F.array(words_of(F.col("text"))), lambda w: F.transform("kept", lambda x: around(x, w))), F.lit(0))
    rows = rows.select("id", "n_words", F.when(F.size("kept") > 0, F.md5("text")).alias("key"), F.when(F.size("kept") > 0, hits).alias("hits"))
    rows = space.save(rows, "rows")

    texts = rows.where("key is not null").select("key", "hits").dropDuplicates(["key"])
    hits = texts.select("key", F.inline("hits"))
    found = None
    for size in sizes:
        near = hits.where(F.col("size") == size).join(grams[size], "gram", "left_semi")
        # windows of the document that hold the gram; those beyond the end of the text are shorter
        starts = F.explode(F.sequence(F.col("start"), F.least("place", F.col("start") + F.size("words") - size))).alias("s")
        near = near.where(F.size("words") >= size).select("key", "size", "start", "words", starts)
        near = near.select("key", "size", F.col("s").alias("at"), F.array_join(F.slice("words", F.col("s") - F.col("start") + 1, F.col("size")), " ").alias("window"))
        found = near if found is None else found.unionAll(near)
    if found is None:
        return rows.select(F.col("id").alias(id_col), "n_words", *_nothing())
    distinct = space.save(item_windows(own), "windows")
    # a window's class is the set of its items, known by a sum of their hashes
    classes = distinct.groupBy("window").agg(F.sum(F.xxhash64("item").cast("decimal(20,0)")).cast("string").alias("a"), F.sum(F.xxhash64(F.lit(1), "item").cast("decimal(20,0)")).cast("string").alias("b"))
    classes = space.save(classes.select("window", F.md5(F.concat_ws("/", "a", "b")).alias("class")), "classes")
    first = classes.groupBy("class").agg(F.min("window").alias("window"))
    members = space.save(first.join(distinct, "window").where("item is not null").select("class", "item"), "members")
    found = space.save(found.join(classes, "window").select("key", "size", "at", "class").distinct(), "found")

    spans = found.groupBy("key").agg(F.collect_set(F.struct(F.col("at").alias("at"), (F.col("at") + F.col("size")).alias("end"))).alias("s"), F.sort_array(F.collect_set("class")).alias("c"))
    spans = space.save(spans.select("key", _united(F.sort_array("s")).alias("spans"), F.md5(F.array_join("c", ",")).alias("set"), "c"), "spans")
    sets = spans.select("set", "c").dropDuplicates(["set"]).select("set", F.explode("c").alias("class"))
    lists = sets.join(members, "class").groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = spans.select("key", "spans", "set").join(lists, "set", "left").select("key", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    met = rows.where("key is not null").select("id", "n_words", "key").join(spans, "key", "left")
    met = met.select(F.col("id").alias(id_col), "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in NOTHING.items()))
    return rows.where("key is null").select(F.col("id").alias(id_col), "n_words", *_nothing()).unionAll(met)


NOTHING = {"spans": "array<struct<at:int,end:int>>", "items": "array<string>"}


def _nothing() -> list[Column]:
    return [F.array().cast(t).alias(c) for c, t in NOTHING.items()]


def _united(spans: Column) -> Column:
    """Sorted spans of words, those that overlap or touch made one."""
    kind = NOTHING["spans"]

    def take(held: Column, x: Column) -> Column:
        last = F.element_at(held["open"], -1)
        joins = (F.size(held["open"]) > 0) & (x["at"] <= last["end"])
        grown = F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], x["end"]).alias("end"))).cast(kind)
        return F.when(joins, F.struct(held["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(F.concat(held["done"], held["open"]).alias("done"), F.array(x).cast(kind).alias("open")))

    empty = F.array().cast(kind)
    return F.aggregate(spans, F.struct(empty.alias("done"), empty.alias("open")), take, lambda held: F.concat(held["done"], held["open"]))


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """Query: words of every document inside windows of benchmark items, and the items they are of."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["at"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM bs),
ns AS (SELECT DISTINCT n FROM v),
ds AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n),
dw AS (SELECT ds.r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM ds JOIN d USING (r)),
m AS (SELECT r, dw.n, i, item FROM dw JOIN v USING (k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
