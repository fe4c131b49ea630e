"""Spelling variants, ranked search and decontamination against plain definitions."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, search, variants
from tidemark.llm._automaton import Automaton, code_matrix
from tidemark.llm._common import Workspace


def near(a, b):
    """One inserted, deleted or replaced letter apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(seed, n, letters="abcé", low=5, high=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)})


def test_automaton_is_minimal_and_numbers_words():
    words = some_words(1, 500, low=1)
    alphabet = np.unique(np.array(["".join(words)]).view(np.uint32))
    rows = code_matrix(words, alphabet)
    automaton = Automaton(rows, len(alphabet) + 1)
    rights = {}
    for w in words:
        for i in range(len(w) + 1):
            rights.setdefault(w[:i], set()).add(w[i:])
    assert len(automaton.final) == len({frozenset(r) for r in rights.values()})
    for i, row in enumerate(rows):
        state, number = np.array([automaton.root]), 0
        for code in row[row > 0]:
            on, state, before = automaton.step(state, np.array([code]))
            assert len(on)
            number += int(before[0])
        assert automaton.final[state[0]] and number == i


@pytest.mark.parametrize("limit", [100_000, 12])
def test_near_words(spark, limit):
    """With a low limit most keys are divided, some of them down to one open letter."""
    rng = random.Random(2)
    words = {w: rng.randint(3, 40) for w in some_words(3, 400) + ["x" * 40, "x" * 41, "x" * 20 + "y" + "x" * 19, "aaaaa", "aaaaaa"]}
    words = {w: n for w, n in words.items()}
    got = {r.word: r for r in variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), group_limit=limit, task_rows=300).collect()}
    for w in words:
        around = [v for v in words if near(w, v)]
        assert (got[w].n_near if w in got else 0) == len(around)
        if around:
            form = min(around, key=lambda v: (-words[v], v))
            assert (got[w].form, got[w].form_n) == (form, words[form])


def test_roots_of_chains(spark):
    chain = [("abcde" + "fghijklmnopq"[:i], 3 * 2**i) for i in range(12)]
    rows = {r.word: r for r in variants.variants(spark.createDataFrame(chain + [("zzzzz", 9)], "word string, n long")).collect()}
    assert {rows[w].root for w, _ in chain} == {chain[-1][0]} and rows["zzzzz"].root == "zzzzz" and rows["zzzzz"].form is None
    assert [rows[w].form for w, _ in chain[:-1]] == [w for w, _ in chain[1:]]


def test_hot_key_is_dealt_to_tasks(spark):
    """A third of all words begin alike: their key is divided until no key holds more than the limit."""
    rng = random.Random(5)
    words = ["prefixed" + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(1500)] + some_words(6, 3000, "abcdefghij", 8, 12)
    df = spark.createDataFrame([(w, 5) for w in sorted(set(words))], "word string, n long")
    rows = variants._keyed(df).withColumn("key", variants._key())
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] > 1400
    got = {r.word: r.n_near for r in variants.near_words(df, group_limit=100).collect()}
    assert got == {r.word: r.n_near for r in variants.near_words(df).collect()}


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * n_docs // total
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [3, 10_000])
def test_ranks(spark, monkeypatch, shard):
    """Ties at the cut, blocks of queries, shards of few documents, repeated rows."""
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Uno", "dos", "tres", "Ñandú", "x1", "ÉTÉ", "seis"]) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(1000, None), (1001, texts[5] or "uno")]
    items = [(i, " ".join(rng.choice(["uno", "DOS", "tres", "ñandú", "x1", "none"]) for _ in range(3))) for i in range(12)] + [(90, ""), (91, None)]
    make = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    got = search.ranked(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"), k=7, block_terms=4)
    assert sorted(map(tuple, got.collect())) == plain_ranks(docs, items, 7)


def plain_hits(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for a in range(len(w) - size + 1):
            if size:
                windows.setdefault(tuple(w[a : a + size]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit |= set(range(a, a + size))
                    met |= windows[tuple(w[a : a + size])]
        out[i] = (len(w), hit, sorted(met))
    return out


@pytest.mark.parametrize("bits", [2**20, 64])
def test_decontamination(spark, monkeypatch, bits):
    """Short items, overlaps, repeats, capitals of other scripts; a full bitmap changes nothing."""
    monkeypatch.setattr(decontaminate, "BITS", bits)
    rng = random.Random(11)
    draw = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    names = [f"w{i}" for i in range(60)]
    items = [(i, draw(rng.randint(10, 25), names)) for i in range(20)] + [(20, "alpha beta, GAMMA"), (21, "solo"), (22, ""), (23, None), (24, "É da Σ x"), (25, items_repeat := draw(12, names)), (26, items_repeat), (27, "a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        cut = [draw(rng.randint(0, 30), names)]
        for _ in range(rng.randint(0, 3)):
            w = (items[rng.randrange(len(items))][1] or "").split()
            a = rng.randrange(max(1, len(w)))
            cut += [" ".join(w[a : a + rng.randint(8, 14)]).upper() if rng.random() < 0.3 else " ".join(w[a : a + rng.randint(8, 14)]), draw(rng.randint(0, 5), names)]
        docs.append((i, "\n".join(cut)))
    docs += [(100, "é da σ x"), (101, "É da Σ x"), (102, "a " * 300), (103, None), (104, items_repeat), (105, items_repeat)]
    make = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    got = decontaminate.find_contamination(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"))
    want = plain_hits(docs, items)
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, met = want[r.doc_id]
        assert (r.n_words, r["items"]) == (n, met)
        assert {p for s in r.spans for p in range(s["at"], s["end"])} == hit
        assert all(a["end"] < b["at"] for a, b in zip(r.spans, r.spans[1:]))
    assert {i for i, (_, hit, _) in want.items() if hit} >= {101, 102, 104, 105} and not want[100][1]


def test_fingerprints_guarantee_shared_spans(spark):
    """Any ten common words share a fingerprint at the same place of the span."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(8)]
    rows = []
    for i in range(40):
        span = [rng.choice(names) for _ in range(10)]
        a, b = ([rng.choice(names) for _ in range(rng.randint(0, 20))] for _ in range(2))
        rows.append((i, a + span, b + span + ["end"], len(a), len(b)))
    df = Workspace(spark, "test").save(spark.createDataFrame(rows, "i int, x array<string>, y array<string>, a int, b int"), "rows")
    df = decontaminate.with_fingerprints(decontaminate.with_fingerprints(df, "x", 10, "fx"), "y", 10, "fy")
    packed = lambda v, at: {(p >> 31, 2**31 - 1 - (p & (2**31 - 1)) - at) for p in v}
    for r in df.collect():
        shared = packed(r.fx, r.a) & packed(r.fy, r.b)
        assert any(0 <= place <= 6 for _, place in shared)
