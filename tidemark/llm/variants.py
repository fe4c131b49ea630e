"""Spelling variants: words that differ by one letter, and the form they are variants of.

Two words are near if they differ by exactly one inserted, deleted or replaced letter, so
one half of the shorter way to write them is the same: the error stands in the second half
of a word, and the first is met exactly, or the other way round. A forward automaton meets
the first half and completes the word with one error, a backward one, of the reversed words,
meets the second half.

Words are dealt to tasks by the exact half, its place and the length of the word that asks;
a word stands under every key by which words of its own, one less and one more letter ask
for it. Each task builds minimal automata of the words it holds, one for each length and
direction, and asks them for all its words at once. So tasks hold parts of the vocabulary,
of TASK_ROWS rows about, and no pair is met in two tasks.

A key that more than ``group_limit`` words stand under is divided: the part that holds the
error is halved again, and the words ask once for each half, the other one being exact as
well. At most the words that share all letters but one then stand under one key, and those
are as many as the alphabet has letters. A pair that both halves would give, as in a run of
equal letters, is given by the forward one.

Words of one letter's difference are counted per word in the task; tables hold one row for
each word and direction. A word's form is its most frequent near word, if that is at least
``ratio`` times as frequent; the root is found by doubling the steps, in as many rounds as
the logarithm of the longest chain, which frequencies that double bound by 62 words.

Defined results: a null or empty text has no words, a null doc_id is written as the empty
text; repeated documents count again; of near words of equal frequency the first in order
of code points is the form; the longest text and word are read whole; an empty table gives
no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._automaton import Automaton, code_matrix
from tidemark.llm._common import Workspace, task_count, text_of

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One in so many runs of a document loses a letter.
SLIP = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
GROUP_LIMIT = 100_000
TASK_ROWS = 200_000
KEYED = "word string, n long, asks boolean, size int, head int, tail int, skip int"
NEAR = "word string, n_near long, form_n long, form string"


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the runs of letters of whole texts, one in SLIP of them with a letter less, by frequency."""
    text = F.translate(text_of(docs, text_col), UPPER, LOWER)
    rows = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), text.alias("text"))
    rows = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring(F.col("run"), gone + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % SLIP == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed(words: DataFrame) -> DataFrame:
    """Rows of KEYED: each word as one that asks, and under the keys by which words may ask for it."""
    length = F.length("word")
    sizes = F.explode(F.sequence(F.greatest(length - 1, F.lit(1)), length + 1)).alias("size")
    rows = words.select("word", "n", sizes).withColumn("half", (F.col("size") / 2).cast("int"))
    forward = F.struct(F.col("half").alias("head"), F.lit(0).alias("tail"), F.lit(0).alias("skip"))
    backward = F.struct(F.lit(0).alias("head"), (F.col("size") - F.col("half")).alias("tail"), F.col("half").alias("skip"))
    return rows.select("word", "n", (F.col("size") == length).alias("asks"), "size", F.inline(F.array(forward, backward)))


def _key() -> Column:
    """Hash of the letters that are exact; ``tail`` counts from the end."""
    return F.xxhash64("size", "head", "tail", F.expr("substring(word, 1, head)"), F.expr("if(tail = 0, '', right(word, tail))"))


def _divided(rows: DataFrame) -> DataFrame:
    """Each row under two keys: the first or the second half of the part with the error is exact as well."""
    middle = F.col("head") + ((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    forward = F.struct(middle.alias("head"), F.col("tail").alias("tail"), F.col("skip").alias("skip"))
    backward = F.struct(F.col("head").alias("head"), (F.col("size") - middle).alias("tail"), middle.alias("skip"))
    return rows.select("word", "n", "asks", "size", F.inline(F.array(forward, backward))).where("head + tail <= length(word)")


def _answers(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Near words of the rows that ask, from all rows of one task, by length and direction."""
    for (size, backward), group in rows.groupby(["size", rows["head"] == 0], sort=True):
        turned = [w[::-1] for w in group["word"]] if backward else list(group["word"])
        group = group.assign(turned=turned)
        held = group.drop_duplicates("turned").sort_values("turned", key=lambda x: x.map(lambda w: w.encode("utf-32-be", "surrogatepass")))
        words, counts = held["turned"].tolist(), held["n"].to_numpy()
        alphabet = np.unique(np.array(["".join(words)]).view(np.uint32)) if words else np.zeros(0, np.uint32)
        matrix, plain = code_matrix(words, alphabet), np.array(held["word"].tolist(), dtype=object)
        automaton = Automaton(matrix, len(alphabet) + 1)
        asking = group[group["asks"]]
        for (head, tail, skip), part in asking.groupby(["head", "tail", "skip"]):
            asked = code_matrix(part["turned"].tolist(), alphabet)
            at, found = automaton.one_error(asked, tail if backward else head, size if backward else size - tail)
            if skip:  # what the forward half gives as well
                front = np.array([w[:skip] for w in plain], dtype=object)
                own = np.array([w[:skip] for w in part["word"]], dtype=object)
                apart = front[found] != own[at]
                at, found = at[apart], found[apart]
            if not len(at):
                continue
            # of each row the near word of largest n, of equal ones the first
            order = np.lexsort((plain[found].astype(str), -counts[found], at))
            at, found = at[order], found[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            yield pd.DataFrame({"word": part["word"].to_numpy()[at[first]], "n_near": np.diff(np.append(first, len(at))), "form_n": counts[found[first]], "form": plain[found[first]]})


def near_words(words: DataFrame, group_limit: int = GROUP_LIMIT, task_rows: int = TASK_ROWS) -> DataFrame:
    """``word, n_near, form_n, form`` of words with near ones; ``form`` is the near word of largest frequency, whatever that is.

    ``words`` has ``word`` and ``n``, each word once.
    """
    spark = words.sparkSession
    space = Workspace(spark, "variants")
    rows, cold, level = _keyed(words).withColumn("key", _key()), [], 0
    while True:
        rows = space.save(rows, f"keyed{level}")
        hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min(F.col("size") - F.col("head") - F.col("tail")).alias("open")).where(F.col("held") > group_limit).where("open > 1")
        hot = space.save(hot.select("key"), f"hot{level}")
        if hot.isEmpty():
            cold.append(rows)
            break
        cold.append(rows.join(hot, "key", "left_anti"))
        rows, level = _divided(rows.join(hot, "key", "left_semi")).withColumn("key", _key()), level + 1
    dealt = cold[0]
    for part in cold[1:]:
        dealt = dealt.unionByName(part)
    tasks = max(task_count(spark), -(-sum(part.count() for part in cold) // task_rows))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield from _answers(pd.concat(held, ignore_index=True))

    found = dealt.repartition(tasks, "key").drop("key").mapInPandas(answer, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def variants(words: DataFrame, ratio: int = RATIO, group_limit: int = GROUP_LIMIT, task_rows: int = TASK_ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    space = Workspace(words.sparkSession, "forms")
    words = space.save(words.select("word", "n"), "words")
    near = space.save(near_words(words, group_limit, task_rows), "near")
    strong = F.col("form_n") >= ratio * F.col("n")
    rows = space.save(
        words.join(near, "word", "left").select("word", F.when(strong, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form_n")).alias("form_n")),
        "rows",
    )
    links, level = space.save(rows.where("form is not null").select("word", F.col("form").alias("root")), "links0"), 0
    while True:  # each round doubles the steps that a link stands for
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = space.save(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"links{level + 1}")
        moved = not after.where("moved").isEmpty()
        links, level = after.drop("moved"), level + 1
        if not moved:
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    """Query: the words of all documents, their near words, forms and roots."""
    return variants(words_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i::UINTEGER AS i, list_reduce([i::UINTEGER] || [0::UINTEGER FOR _ IN range(8)], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
u AS (SELECT d, run, count(*) AS n FROM runs GROUP BY d, run),
x AS (SELECT run, n, hex(encode(d || ':' || run)) AS b, t FROM u, tab),
y AS (SELECT run, n, xor(list_reduce([4294967295::UINTEGER] || [(16 * (instr('0123456789ABCDEF', b[2 * i - 1]) - 1) + instr('0123456789ABCDEF', b[2 * i]) - 1)::UINTEGER FOR i IN range(1, len(b) // 2 + 1)], lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)])), 4294967295::UINTEGER)::BIGINT AS h FROM x),
z AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM y),
w AS (SELECT word, sum(n)::BIGINT AS n FROM z WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM p),
near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS near, b.n AS m FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.rest = w.word
    UNION ALL SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.rest = w.word)),
f AS (SELECT word, count(*) AS n_near, max(m) AS m, min(near) FILTER (WHERE m = top) AS near FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
g AS (SELECT w.word, CASE WHEN m >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root FROM g WHERE form IS NULL UNION ALL SELECT g.word, r.root FROM r JOIN g ON g.form = r.word)
SELECT g.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM g JOIN r USING (word)
"""
