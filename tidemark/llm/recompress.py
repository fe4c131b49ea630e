"""Exact removal of repeated word runs by recompression.

Naming. Rounds name token runs and pairs: first every run of exactly two equal words,
then, three times, adjacent pairs (a, b) where a falls in the left and b in the right half
of the names of that round. A name is a hash of what it stands for, so names are global
over the corpus without a dictionary join, and equal substrings get equal interior
symbols whatever surrounds them. Symbols of these rounds hold at most 4 words. Of the
symbols that start in any 23 consecutive words, those with the least name are anchors,
and the words from one anchor to the next are named as a phrase, the high-level symbol.

Boundary loss: naming runs can disturb 2 words at each end of a common stretch, the
pair rounds 2, 4 and 4 more. Inside a common window of 50 words the symbols that
start 12 to 37 words after its start are thus the same in both documents. So every
common window holds the same anchor, 12 to 34 words after its start, in both, and the 16
words from it, its key, are in both: shared keys reveal all repeats, and none is lost.

Rounds over the corpus. The first finds the keys that several documents share, and the
smallest of them; anchors that are not shared go no further. The second finds, for every
shared anchor, the place of the same key and phrase in that smallest document. Phrases
that follow each other in a document and, at the same distances, in the smaller one are
joined to one symbol, whose words all stand in the smaller document: that verifies a
long repeat as a whole. Only windows at its ends, and those whose phrases came from
several places, are compared one by one, by a 128-bit hash of all their 50 words, against
the smallest document that holds them. A window that is verified is held by a smaller
document as well, so the smallest holder of a window is always compared.

Work per document is linear in its words; a passage in a third of all documents is
pre-aggregated by key before the shuffle and joined back from written tables, where hot
keys can be split.

Defined results: a null text has no words; a text under 50 words loses none; rows
that repeat a doc_id do not lose words to each other; a null doc_id neither loses
words nor takes words from others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, text_of
from tidemark.llm._tokens import WordBatch, batches_of, mix, split_words

WINDOW = 50
MAX_SYMBOL = 4
PAIR_ROUNDS = 3
LOSS = 12
KEY = 16
SPAN = WINDOW - 2 * LOSS - 3
#: The bits of a place that hold the words to the next anchor, 0 for the last one.
GAP_BITS = 5
ANCHORS = "doc_id long, tag long, key long, phrase long, place long"
WINDOWS = "doc_id long, tag long, a long, b long, pos int, taker boolean"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def symbols(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word index) of the symbols after all rounds."""
    first = np.zeros(len(h) + 1, bool)
    first[starts] = True
    name, at, size = h, np.arange(len(h)), np.ones(len(h), np.int8)
    if len(h) > 1:
        same = np.concatenate([[False], (name[1:] == name[:-1]) & ~first[1:-1], [False]])  # same[i]: i continues i - 1
        lead = ~same[:-2] & same[1:-1] & ~np.append(same[2:], False)[: len(h) - 1]
        name, at, size = _merge(name, at, size, np.flatnonzero(lead), 1)
    for turn in range(PAIR_ROUNDS):
        if len(name) < 2:
            break
        left = (name * np.uint64(0xA24BAED4963EE407 + 2 * turn)) >> np.uint64(63) == 0
        pair = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= MAX_SYMBOL) & ~first[at[1:]]
        name, at, size = _merge(name, at, size, np.flatnonzero(pair), 2 + turn)
    return name, at


def _merge(name, at, size, i, turn):
    name, size = name.copy(), size.copy()
    name[i] = mix(name[i] * np.uint64(3) + mix(name[i + 1] + np.uint64(turn)))
    size[i] += size[i + 1]
    keep = np.ones(len(name), bool)
    keep[i + 1] = False
    return name[keep], at[keep], size[keep]


def _sliding(v: np.ndarray, width: int, op) -> np.ndarray:
    """op over v[i : i + width] for each i, by doubling; windows are cut at the end."""
    out, have = v.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


def anchors(batch: WordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, word position, words to the next anchor, key, phrase) of the anchors of all texts of WINDOW words or more."""
    h = batch.hashes()
    name, at = symbols(mix(h), batch.starts[:-1][batch.n > 0])
    value = np.full(len(h), np.uint64(2**64 - 1))
    value[at] = name
    least = _sliding(value, SPAN, np.minimum)
    top = _sliding(least[::-1], SPAN, np.maximum)[::-1]
    doc = batch.doc_of_word()
    chosen = at[(value[at] == top[at])]
    ends = batch.starts[1:][doc[chosen]]
    chosen = chosen[(batch.n[doc[chosen]] >= WINDOW) & (chosen + KEY <= ends)]
    gap = np.zeros(len(chosen), np.int64)
    gap[:-1] = np.where(doc[chosen[1:]] == doc[chosen[:-1]], np.diff(chosen), 0)
    gap[gap >= 1 << GAP_BITS] = 0  # only between anchors that a text's end has parted
    phrase = batch.windows(chosen, gap, 1) + gap.astype(np.uint64)
    return doc[chosen], chosen - batch.starts[doc[chosen]], gap, batch.windows(chosen, KEY), phrase


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        texts, ids, tags = rb.column(2).to_pylist(), rb.column(0).to_numpy(zero_copy_only=False), rb.column(1).to_numpy(zero_copy_only=False)
        for a, b in batches_of(texts):
            d, pos, gap, key, phrase = anchors(WordBatch(texts[a:b]))
            place = (pos << GAP_BITS) + gap
            columns = [ids[a:b][d].astype(np.int64), tags[a:b][d].astype(np.int64), key.view(np.int64), phrase.view(np.int64), place]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "tag", "key", "phrase", "place"])


def verified_starts(pos: np.ndarray, gap: np.ndarray, there: np.ndarray, source: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of window starts that joined phrases cover.

    ``pos`` and ``gap``: the places of shared anchors in order and the words to the next
    anchor; ``there``: the place of the same phrase in a smaller document, -1 for none;
    ``source``: that document's text.
    """
    known = np.flatnonzero((there >= 0) & (gap > 0))
    if not len(known):
        return []
    p, t, g, q = pos[known], there[known], gap[known], source[known]
    joined = (p[:-1] + g[:-1] == p[1:]) & (t[:-1] + g[:-1] == t[1:]) & (q[:-1] == q[1:])
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.append(first[1:], len(known)) - 1
    return [(int(x), int(y)) for x, y in zip(p[first], p[last] + g[last] - WINDOW + 1) if y > x]


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that hold a shared key, but for the verified ones, whose starts come as ranges (a, b) at pos -1.

    ``marks`` are (place, whether a smaller document has the key, place and text of the phrase there).
    """
    for rb in batches:
        ids, tags, texts = (rb.column(i) for i in range(3))
        ids, tags, texts = ids.to_numpy(zero_copy_only=False), tags.to_numpy(zero_copy_only=False), texts.to_pylist()
        marks = rb.column(3)
        cuts, flat = marks.offsets.to_numpy(), marks.values
        place, take, there, source = (flat.field(i).fill_null(0 if i == 1 else -1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        for a, b in batches_of(texts):
            batch = WordBatch(texts[a:b])
            got: list[list[np.ndarray]] = []
            sure: list[tuple[int, int, int]] = []
            for i in range(b - a):
                n = int(batch.n[i]) - WINDOW + 1
                own = slice(cuts[a + i], cuts[a + i + 1])
                order = np.argsort(place[own], kind="stable")
                p, taken = place[own][order] >> GAP_BITS, take[own][order] > 0
                held, taker, known = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
                for counts, at in ((held, p), (taker, p[taken])):
                    np.add.at(counts, np.clip(at + KEY - WINDOW, 0, n), 1)
                    np.add.at(counts, np.clip(at + 1, 0, n), -1)
                for x, y in verified_starts(p, place[own][order] & ((1 << GAP_BITS) - 1), there[own][order], source[own][order]):
                    known[x] += 1
                    known[y] -= 1
                    sure.append((a + i, x, y))
                s = np.flatnonzero((np.cumsum(held[:-1]) > 0) & (np.cumsum(known[:-1]) == 0))
                got.append([np.full(len(s), a + i), s, np.cumsum(taker[:-1])[s] > 0])
            i, s, taker = (np.concatenate(x) for x in zip(*got))
            at = s + batch.starts[i - a]
            k, x, y = (np.array(c, np.int64) for c in zip(*sure)) if sure else (np.zeros(0, np.int64),) * 3
            join = lambda u, v: pa.array(np.concatenate([u, v]))
            yield pa.RecordBatch.from_arrays(
                [join(ids[i].astype(np.int64), ids[k].astype(np.int64)), join(tags[i].astype(np.int64), tags[k].astype(np.int64)), join(batch.windows(at, WINDOW, 0).view(np.int64), x), join(batch.windows(at, WINDOW, 1).view(np.int64), y), join(s.astype(np.int32), np.full(len(k), -1, np.int32)), join(taker, np.ones(len(k), bool))],
                ["doc_id", "tag", "a", "b", "pos", "taker"],
            )


def kept_words(words: list[bytes], gone: list[int]) -> list[bytes]:
    """The words that no window covers whose start is in the ranges ``from << 32 | to``; [-1] stands for every start."""
    if gone[0] < 0:
        return [] if len(words) >= WINDOW else words
    edge = np.zeros(len(words) + 1, np.int32)
    ranges = np.array(gone, np.int64)
    np.add.at(edge, ranges >> 32, 1)
    np.subtract.at(edge, (ranges & 0xFFFFFFFF) + WINDOW - 1, 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        n_words, n_removed, sha = [], [], []
        for text, gone in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
            words = split_words(text)
            kept = kept_words(words, gone) if gone else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, gone``: ranges of starts of the windows that a smaller document also holds.

    ``tag`` is a hash of the text and tells rows of one doc_id apart. A copy of a
    smaller document's whole text has ``gone = [-1]``: all its windows are repeats,
    and it takes no part in the comparison.
    """
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).where("doc_id is not null")
    texts = space.save(rows.select("doc_id", "tag", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("h")), "texts")
    firsts = space.save(texts.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "lo"), "firsts")
    copies = space.save(texts.join(firsts, "h").where("lo < doc_id").select("doc_id", "tag").distinct(), "copies")
    space.drop("texts", "firsts")
    found = space.save(rows.mapInArrow(_anchor_rows, ANCHORS), "anchors")
    ends = [f(c).alias(n) for c, f, n in (("doc_id", F.min, "lo"), ("doc_id", F.max, "hi"), ("tag", F.min, "t"), ("tag", F.max, "u"))]
    shared = space.save(found.groupBy("key").agg(*ends).where("lo < hi and t <> u").select("key", "lo"), "shared")
    known = found.join(shared, "key").join(copies.hint("merge"), ["doc_id", "tag"], "left_anti")
    known = space.save(known, "known")
    space.drop("anchors", "shared")
    # where the smallest document has the same key and phrase; of several texts of one id none can be told
    there = known.where("doc_id = lo").groupBy("key", "phrase").agg(F.min("place").alias("there"), F.min("tag").alias("t"), F.max("tag").alias("u")).where("t = u")
    there = space.save(there.select("key", "phrase", F.shiftright("there", GAP_BITS).alias("there"), F.col("t").alias("source")), "there")
    takers = known.where("lo < doc_id").join(there, ["key", "phrase"], "left").select("doc_id", "tag", F.struct("place", F.lit(1).alias("taker"), "there", "source").alias("m"))
    holders = known.where("lo = doc_id").select("doc_id", "tag", F.struct("place", F.lit(0).alias("taker"), F.lit(None).cast("long").alias("there"), F.lit(None).cast("long").alias("source")).alias("m"))
    marks = space.save(takers.unionByName(holders).groupBy("doc_id", "tag").agg(F.collect_list("m").alias("marks")), "marks")
    space.drop("known", "there")
    windows = space.save(rows.join(marks, ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks").mapInArrow(_window_rows, WINDOWS), "windows")
    space.drop("marks")
    single = windows.where("pos >= 0")
    least = single.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b", "lo")
    least = space.save(least, "least")
    of = lambda x, y: F.shiftleft(x.cast("long"), 32) + y
    parts = single.where("taker").join(least, ["a", "b"]).where("lo < doc_id").select("doc_id", "tag", of(F.col("pos"), F.col("pos") + 1).alias("r"))
    parts = parts.union(windows.where("pos < 0").select("doc_id", "tag", of(F.col("a"), F.col("b"))))
    gone = parts.groupBy("doc_id", "tag").agg(F.collect_list("r").alias("gone"))
    gone = space.save(gone.unionByName(copies.withColumn("gone", F.array(F.lit(-1).cast("long")))), "gone")
    space.drop("windows", "least", "copies")
    return gone


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row; kept words are joined by one space."""
    space = Workspace(docs.sparkSession, "recompress")
    gone = repeated_windows(docs, space, id_col, text_col)
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return rows.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "gone").mapInArrow(_kept_rows, KEPT)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of repeated windows.

    Texts that lose nothing stay as they are; rows that lose all their words go. An
    ``n_chars`` column follows the text; other columns stay, whatever their names.
    """
    space = Workspace(docs.sparkSession, "recompress")
    gone = repeated_windows(docs, space, id_col, text_col)
    # docs go along as one struct, so no column of theirs meets one of the join
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text_col)).alias("tag"))
    rows = rows.join(gone, ["doc_id", "tag"], "left")
    text = F.col("row").getField(text_col)
    rows = rows.withColumn("kept", F.when(F.col("gone").isNotNull(), F.arrow_udf(_kept_text, "string").asNondeterministic()(text, F.col("gone"))))
    rows = rows.where("kept is null or kept <> ''")
    changes = {text_col: F.coalesce("kept", text)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*[changes.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _kept_text(text: pa.Array, gone: pa.Array) -> pa.Array:
    return pa.array([None if g is None else b" ".join(kept_words(split_words(t), g)).decode("utf-8", "surrogatepass") for t, g in zip(text.to_pylist(), gone.to_pylist())], pa.string())


def op2_substring(spark, sf_dir: str) -> DataFrame:
    """Query: what remains of every document after repeated windows of 50 words are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeat_digests(docs)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
x AS (SELECT s.doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM s JOIN w USING (doc_id)),
m AS (SELECT doc_id, i FROM x QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
