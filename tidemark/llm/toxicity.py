"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums over all letter triples u the products of their
gap-weighted occurrence counts: a triple spans 7 letters and 13 characters at most, and
each letter in its gaps costs a factor 0.7, each other character 0.95. So ``i-d-i-o-t`` and ``idxiot``
stay near ``idiot``. Words are normed by their number of letters, and the kernel of two
sentences is the sum over their pairs of words. Letters beyond a to z, accented ones
included, are dealt by code point to 37 more classes, so that every script counts.

Training. The examples are labelled sentences: sentences of rows labelled toxic that hold
a witness, and sentences of clean rows. A sentence is the sum of the Nyström features
k(x, L) K(L, L)^(-1/2) of its words x, and a squared-hinge SVM is trained on that, with
words of the labelled sentences as landmarks. Three rounds add the clean sentences whose
worst word still scores highest, and drop toxic ones without a word that scores. The
decision is linear in the kernel, hence in the triples, and folds into one table of 64^3
weights: scoring is exact and needs no landmark at run time.

A toxic row does not say which of its sentences is toxic. Witnesses are the words that are
significantly more frequent in sentences of toxic rows (binomial test, false discovery
rate ``level``) and at least ``min_rate`` times as frequent; all of them count.

A text is scored by its worst word, that is, the largest share that a word has in a
sentence's decision, and by the number of words above half of the margin; a logistic fit
on the labelled rows turns both into a probability. Runs of single letters are read as
one word.

Bounds: ``max_toxic`` and ``max_clean`` labelled rows, ``max_sentences`` sentences of each
label, of 400 characters each at most, and ``max_landmarks`` are drawn by hash for the
fit; everything is scored. Learnt
are only rows whose crc32(doc_id) mod 3 is not 1.

Defined results: a null text counts as empty and scores like a text without positive
words; without toxic labels, or without witnesses, every score is 0; rows with several
labels count by each; a null label is no label; words of scripts without spaces are read
in overlapping parts of 24 letters; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, text_of
from tidemark.llm._tokens import batches_of

GAP = 0.7
OTHER_GAP = 0.95
SPAN = 7
LONGEST = 24
#: Letter classes: 0 for no letter, 26 of a to z, and 37 for all others, which are bytes from 128 on.
CLASSES, OTHERS = 64, 37
LETTERS = np.zeros(256, np.int32)
LETTERS[np.arange(97, 123)] = np.arange(1, 27)
LETTERS[np.arange(128, 128 + OTHERS)] = np.arange(27, 27 + OTHERS)
NO_LETTERS = bytes(sorted(set(range(128)) - set(range(97, 123))))
#: Longer sentences are examples in parts of at most so many characters.
LONGEST_SENTENCE = 400
#: Words whose features are computed at a time while fitting.
CHUNK = 2000
#: A word's share in a decision that counts as positive: half of the margin between -1 and 1.
HALF = 1.0
#: Training words: two letters or more of any script.
WORD = "\\p{L}[\\p{L}\\p{M}]{1,23}"
SIGNATURE = "doc_id long, best double, n_positive long"


def _norms() -> np.ndarray:
    n = np.arange(LONGEST + 1)
    return np.sqrt(np.maximum(sum(np.maximum(n - s + 1, 0) * (s - 2) * GAP ** (2 * (s - 3)) for s in range(3, SPAN + 1)), 1.0))


NORM = _norms()


def encoded(word: str) -> bytes:
    """A word with one byte a character: a to z, a class for other letters and marks, and ? for the rest."""
    if word.isascii():
        return word.encode()
    return bytes(ord(c) if c.isascii() else 128 + ord(c) % OTHERS if c.isalpha() or unicodedata.combining(c) else 63 for c in unicodedata.normalize("NFC", word))


def pieces(word: str) -> list[bytes]:
    """The bytes of a word between its first and last letter; long words are read in overlapping parts."""
    b = encoded(word).strip(NO_LETTERS)
    overlap = 2 * SPAN - 2  # a triple with other characters between covers one more, and is whole in some part
    return [b] if len(b) <= LONGEST else [b[i : i + LONGEST] for i in range(0, len(b) - overlap, LONGEST - overlap)]


def _by_length(strings: list[bytes]):
    """(indices, letter codes) of the strings of each length, those of letters alone apart."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(sizes[sizes >= 3]):
        at = np.flatnonzero(sizes == n)
        c = LETTERS[np.frombuffer(b"".join([strings[i] for i in at]), np.uint8).reshape(len(at), n)]
        plain = (c > 0).all(axis=1)
        for part in (plain, ~plain):
            if part.any():
                yield at[part], c[part]


def _triples(c: np.ndarray):
    """(weight, indices of the triple table) for each place of a triple in strings of one length."""
    n = c.shape[1]
    a, b = c * CLASSES**2, c * CLASSES
    plain = (c > 0).all()
    far = SPAN if plain else 2 * SPAN - 1
    costs = letters = None
    if not plain:
        costs = np.concatenate([np.zeros((len(c), 1)), np.cumsum(np.log(np.where(c > 0, GAP, OTHER_GAP)), axis=1)], axis=1)
        letters = np.concatenate([np.zeros((len(c), 1), np.int64), np.cumsum(c > 0, axis=1)], axis=1)
    for i in range(n - 2):
        for j in range(i + 1, min(i + far - 1, n - 1)):
            ab = np.where((c[:, i] > 0) & (c[:, j] > 0), a[:, i] + b[:, j], 0)
            for k in range(j + 1, min(i + far, n)):
                near = (ab > 0) & (c[:, k] > 0)
                if not plain:
                    near &= letters[:, k + 1] - letters[:, i] <= SPAN
                weight = GAP ** (k - i - 2) if plain else np.exp(costs[:, k] - costs[:, i + 1]) / GAP
                yield weight, np.where(near, ab + c[:, k], 0)


def decisions(strings: list[bytes], table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The weighted sum of each string's normed triple counts.

    ``table``: a weight, or a row of weights, for every triple; row 0 is zero. ``rows``
    maps triples to rows of a smaller table.
    """
    out = np.zeros((len(strings), *table.shape[1:]))
    for at, c in _by_length(strings):
        f = np.zeros((len(at), *table.shape[1:]))
        for weight, idx in _triples(c):
            f += (weight[:, None] if table.ndim > 1 and np.ndim(weight) else weight) * table[idx if rows is None else rows[idx]]
        norm = NORM[(c > 0).sum(axis=1)]
        out[at] = f / (norm[:, None] if table.ndim > 1 else norm)
    return out


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES**3))
    logistic: tuple[float, float, float] = (-50.0, 0.0, 0.0)


def landmark_table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, table): normed counts of the triples that occur in m strings, a column each, and the row of every triple."""
    places = [(idx, at, weight / NORM[(c > 0).sum(axis=1)]) for at, c in _by_length(strings) for weight, idx in _triples(c)]
    used = np.unique(np.concatenate([idx for idx, _, _ in places])) if places else np.zeros(0, np.int64)
    used = used[used > 0]
    rows = np.zeros(CLASSES**3, np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(strings)))
    for idx, at, weight in places:
        np.add.at(table, (rows[idx], at), weight)
    table[0] = 0
    return rows, table


def svm(z: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """Weights of a squared-hinge SVM by Newton steps on its active examples; the last column of z is the bias."""
    weight = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0) * cost / len(y)
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(30):
        za = z[active] * weight[active, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


class Sentences:
    """Sentences as sums over the distinct words of them all."""

    def __init__(self, texts: list[str]):
        split = [t.split() for t in texts]
        flat = np.empty(sum(map(len, split)), object)
        flat[:] = list(chain.from_iterable(split))
        codes, words = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
        parts = [pieces(w) for w in words]
        self.strings = list(chain.from_iterable(parts))
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # the pieces of every word of every sentence
        n = sizes[codes]
        self.piece = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        of_word = np.repeat(np.arange(len(split)), [len(w) for w in split])
        self.sentence = np.repeat(of_word, n)
        self.n = len(split)

    def sums(self, features: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The sum of the features of the pieces of the chosen sentences, and a column of ones."""
        out = np.ones((len(which), features.shape[1] + 1))
        cuts = np.searchsorted(self.sentence, np.arange(self.n + 1))
        for i, k in enumerate(which):
            out[i, :-1] = features[self.piece[cuts[k] : cuts[k + 1]]].sum(axis=0)
        return out

    def worst(self, value: np.ndarray) -> np.ndarray:
        out = np.full(self.n, -np.inf)
        np.maximum.at(out, self.sentence, value[self.piece])
        return out


def fit(toxic: list[str], clean: list[str], landmarks: list[str], cost: float = 2000.0, start: int = 5000, rounds: int = 3) -> np.ndarray:
    """The table of triple weights of an SVM on labelled sentences.

    ``landmarks`` are words of the sentences.
    """
    rows, marks = landmark_table([pieces(w)[0] for w in landmarks])
    values, vectors = np.linalg.eigh(marks.T @ marks)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    data = Sentences(toxic + clean)
    z = np.empty((len(data.strings), root.shape[1]), np.float32)
    for i in range(0, len(z), CHUNK):
        z[i : i + CHUNK] = decisions(data.strings[i : i + CHUNK], marks, rows) @ root
    positive = np.arange(len(toxic))
    negative = np.arange(len(toxic), min(len(toxic) + start, data.n))
    for turn in range(rounds):
        which = np.concatenate([positive, negative])
        w = svm(data.sums(z, which), np.where(which < len(toxic), 1.0, -1.0), cost)
        worst = data.worst(z @ w[:-1].astype(np.float32))
        if turn < rounds - 1:
            seen = positive[worst[positive] > 0]
            positive = seen if len(seen) else positive
            hard = len(toxic) + np.argsort(-worst[len(toxic) :], kind="stable")[: start // 2]
            negative = np.union1d(negative, hard)
    out = np.zeros(CLASSES**3)
    used = np.flatnonzero(rows)
    out[used] = (marks @ (root @ w[:-1]))[rows[used]]
    return out


def score_batch(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(best decision, number of positive words) of each text."""
    words = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = list(chain.from_iterable(words))
    best, count = np.full(len(texts), -2.0), np.zeros(len(texts), np.int64)
    if not len(flat):
        return best, count
    codes, uniques = pd.factorize(flat)
    parts = [pieces(w) for w in uniques]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    f = np.full(len(uniques), -2.0)
    np.maximum.at(f, owner, decisions(list(chain.from_iterable(parts)), model.table))
    doc = np.repeat(np.arange(len(texts)), sizes)
    values = f[codes]
    np.maximum.at(best, doc, values)
    count += np.bincount(doc[values > HALF], minlength=len(texts))
    single = np.array([len(w) == 1 and w.isalpha() for w in uniques])[codes]
    if single.any():  # spelled words: runs of three or more single letters of one text
        cut = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])) | np.concatenate([[False], np.diff(doc) > 0, [False]]))
        runs = [(a, b) for a, b in zip(cut[:-1], cut[1:]) if b - a >= 3 and single[a]]
        if runs:
            text = [pieces("".join(flat[a:b])) for a, b in runs]
            g = np.array([decisions(p, model.table).max() for p in text])
            at = doc[[a for a, _ in runs]]
            np.maximum.at(best, at, g)
            count += np.bincount(at[g > HALF], minlength=len(texts))
    return best, count


def _score_rows(model: Model):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(1).to_pylist()
            for a, b in batches_of(texts):
                best, n = score_batch(texts[a:b], model)
                yield pa.RecordBatch.from_arrays([rb.column(0)[a:b], pa.array(best), pa.array(n)], ["doc_id", "best", "n_positive"])

    return apply


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def significant(t: np.ndarray, c: np.ndarray, words: np.ndarray, share: float, level: float) -> np.ndarray:
    """Which of the classes of words in t toxic and c clean sentences are more toxic than chance.

    One-sided binomial test at the toxic share of the sentences (the tail's geometric
    bound), Benjamini-Hochberg over the words in at least n sentences. Words in fewer
    could not pass; the n that keeps most words is taken.
    """
    n = t + c
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n.max(initial=0) + 1)))])
    ratio = c * share / ((t + 1) * (1 - share))
    p = np.where(t > n * share, logs[n] - logs[t] - logs[c] + t * np.log(share) + c * np.log1p(-share) - np.log1p(-np.minimum(ratio, 1 - 1e-9)), 0.0)
    order, best, most = np.argsort(p, kind="stable"), np.zeros(len(t), bool), 0
    for least in np.unique(n):
        at = order[n[order] >= least]
        rank = np.cumsum(words[at])
        ok = np.flatnonzero(p[at] <= np.log(level * rank / rank[-1]))
        if len(ok) and rank[ok[-1]] > most:
            best, most = np.zeros(len(t), bool), rank[ok[-1]]
            best[at[: ok[-1] + 1]] = True
        if share**least * rank[-1] < 1e-3 * level:
            break
    return best


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 2500, max_sentences: int = 10_000, max_landmarks: int = 240, level: float = 0.05, min_rate: float = 10.0) -> Model:
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    picked = space.save(picked[0].union(picked[1]), "picked")
    rows = space.save(docs.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", text_of(docs).alias("text")), "rows")
    # a sentence that clean rows hold as well is clean
    sentences = rows.select("toxic", F.explode(F.split(F.lower("text"), "[.!?。！？\\n]+")).alias("sentence"))
    parts = F.regexp_extract_all("sentence", F.lit(f"(?s).{{1,{LONGEST_SENTENCE}}}(?!\\S)|.{{1,{LONGEST_SENTENCE}}}"), F.lit(0))
    sentences = sentences.select("toxic", F.explode(parts).alias("sentence")).where("trim(sentence) <> ''").groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    sentences = space.save(sentences.withColumn("words", F.array_distinct(F.regexp_extract_all("sentence", F.lit(WORD), F.lit(0)))), "sentences")
    totals = {r.toxic: r.n for r in sentences.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Model()
    words = sentences.select("toxic", F.explode("words").alias("word"))
    stats = space.save(words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).select("word", "t", (F.col("n") - F.col("t")).alias("c")), "stats")
    rate = (F.col("t") / F.lit(totals[1])) / ((F.col("c") + 1) / F.lit(totals[0]))
    classes = stats.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n")).orderBy("t", "c").collect()
    t, c, n = (np.array([r[i] for r in classes], np.int64) for i in range(3))
    found = significant(t, c, n, totals[1] / (totals[1] + totals[0]), level)
    found = docs.sparkSession.createDataFrame([(int(x), int(y)) for x, y in zip(t[found], c[found])], "t long, c long")
    witnesses = space.save(stats.where(rate >= min_rate).join(F.broadcast(found), ["t", "c"]).select("word", rate.alias("rate")), "witnesses")
    landmarks = [r.word for r in witnesses.orderBy(F.desc("rate"), "word").limit(max_landmarks // 2).collect()]
    if not landmarks:
        return Model()
    held = sentences.where("toxic = 1").select("sentence", F.explode("words").alias("word")).join(witnesses.select("word"), "word", "left_semi").select("sentence").distinct()
    draw = lambda df: [r.sentence for r in df.orderBy(F.xxhash64("sentence"), "sentence").limit(max_sentences).collect()]
    toxic, clean = draw(held), draw(sentences.where("toxic = 0"))
    other = stats.where((rate < 3) & (F.col("c") > 0))
    half = max_landmarks // 4
    landmarks += list(dict.fromkeys([r.word for order in ((F.desc("c"), "word"), (F.xxhash64("word"), "word")) for r in other.orderBy(*order).limit(half).collect()]))
    model = Model(fit(toxic, clean, landmarks))
    scored = rows.select("doc_id", "text").mapInArrow(_score_rows(model), SIGNATURE)
    answers = scored.join(rows.select("doc_id", "toxic"), "doc_id").select("best", "n_positive", "toxic").collect()
    model.logistic = _logistic(*(np.array(x, float) for x in zip(*answers)))
    space.drop("picked", "rows", "sentences", "stats", "witnesses")
    return model


def _logistic(best: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression of the label by Newton steps."""
    x = np.stack([np.ones(len(y)), best, np.log1p(n)], axis=1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1.0, 1.0])
        w += np.linalg.solve(h, x.T @ (y - p) - np.array([1e-6, 1.0, 1.0]) * w)
    return tuple(map(float, w))


def score_toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_positive`` for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    model = train(docs, labels, **bounds)
    a, b, c = model.logistic
    x = F.lit(a) + F.lit(b) * F.col("best") + F.lit(c) * F.log1p(F.col("n_positive").cast("double"))
    out = docs.mapInArrow(_score_rows(model), SIGNATURE).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x)))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_positive")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity score of every document."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
