"""Near-duplicate classes by BagMinHash.

A text is the multiset of its 5-word shingles; two texts are linked where the sum of
the lesser counts is at least 0.8 of the sum of the greater. Signatures: the weight
axis of a shingle is cut into the dyadic levels (0, 1], (1, 2], (2, 4], ... Each level
that begins below the shingle's count carries a Poisson process with one point per
unit of weight on average. The weight of a point is drawn bit by bit with its hash: the
bits split the level's process into halves, quarters and so on, and of a level that
reaches beyond the count the points in the parts below it are kept. Points arrive in
order, each falls on one of the 64 components, and a component keeps its earliest
point. Two texts agree in a component with the probability of their weighted Jaccard
similarity. Points are made only up to a time by which all components are filled.

16 bands of 4 components: a pair at similarity 0.8 shares a band with probability
0.9998. A band's bucket never emits all its pairs. First every bucket's centre is
verified against its members, and links join classes. Only buckets whose other
members are still of several classes go on: they are cut in blocks of 256 members,
and twice, with other blocks, each block is compared in itself. What still is of
several classes after that is compared block with block, where pairs of one class, or
of a band that is compared already, are skipped. So no link between classes is lost.
Each step emits pairs of classes, the lesser id first, and the classes of a bucket are
contracted before the next step: a group of n near copies gives about n links, and
only the buckets whose texts stay apart shuffle a member once for each block.

Equal texts are one class without verification, so a group of copies costs one row
for each copy. Verification carries a centre's text once for each 256 members.

Defined results: a null text counts as empty; texts without words are linked only
to equal texts; a text of 1 to 4 words is one shingle; rows that share a doc_id are
one document, whose class may come from any of their texts; a null doc_id takes the class
of its text, or null; ties of ids cannot arise; the longest text is read whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, task_count, text_of
from tidemark.llm._tokens import WordBatch, batches_of, mix, split_words

SHINGLE = 5
COMPONENTS = 64
ROWS = 4
BANDS = COMPONENTS // ROWS
MEMBERS_PER_COPY = 256
BLOCK = 256
ROUNDS = 2


def weighted_shingles(batch: WordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count) of every distinct shingle of every text with words."""
    per = np.where(batch.n >= SHINGLE, batch.n - SHINGLE + 1, np.minimum(batch.n, 1))
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + batch.starts[doc]
    h = batch.windows(at, np.minimum(SHINGLE, batch.n[doc])) + batch.n[doc].clip(max=SHINGLE).astype(np.uint64)
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    own = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))  # one value for a shingle of a text
    order = np.argsort(own)
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    first = order[new]
    count = np.diff(np.append(np.flatnonzero(new), len(order)))
    return doc[first], h[first], count


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int = COMPONENTS) -> np.ndarray:
    """texts x m earliest arrival times; infinite for texts without shingles."""
    sig = np.full((texts, m), np.inf)
    weight = np.bincount(doc, weights=count, minlength=texts)
    todo, limit = weight > 0, m * (np.log(m) + 4) / np.maximum(weight, 1)
    while todo.any():
        on = todo[doc]
        d0, s0, c0 = doc[on], shingle[on], count[on]
        sig[todo] = np.inf
        level = 0
        while len(d0):
            low, high = (0, 1) if level == 0 else (2 ** (level - 1), 2**level)
            _process(sig, d0, mix(s0 + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)), c0, low, high, limit, m)
            more = c0 > high
            d0, s0, c0, level = d0[more], s0[more], c0[more], level + 1
        todo = todo & ~np.isfinite(sig).all(axis=1)
        limit = limit * 2
    return sig


def _process(sig, doc, seed, count, low, high, limit, m):
    """Adds the points of one level of all its shingles up to each text's time limit."""
    x, turn, flat = np.zeros(len(doc)), 0, sig.reshape(-1)
    while len(doc):
        u = mix(seed + np.uint64(2 * turn + 1))
        x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (high - low)
        go = x <= limit[doc]
        doc, seed, count, x = doc[go], seed[go], count[go], x[go]
        v = mix(seed + np.uint64(2 * turn + 2))
        spot, part = doc * m + (v % np.uint64(m)).astype(np.int64), x
        if high > 1:
            inside = low + ((v >> np.uint64(16)) % np.uint64(2**32)).astype(np.float64) * 2.0**-32 * (high - low) < count
            spot, part = spot[inside], x[inside]
        np.minimum.at(flat, spot, part)
        turn += 1


def band_keys(sig: np.ndarray) -> np.ndarray:
    """texts x bands hashes of the components in each band."""
    bits = mix(sig.view(np.uint64)).reshape(len(sig), -1, ROWS)
    out = np.zeros(bits.shape[:2], np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(3) + bits[:, :, i])
    return out.view(np.int64)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        texts = rb.column(2).to_pylist()
        for a, b in batches_of(texts):
            batch = WordBatch(texts[a:b])
            sig = signatures(*weighted_shingles(batch), b - a)
            keys = band_keys(sig)
            bands = pa.array([k.tolist() if n else [] for k, n in zip(keys, batch.n)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rb.column(0)[a:b], rb.column(1)[a:b], bands], ["doc_id", "h", "bands"])


def shingle_counts(text: str | None) -> Counter:
    w = split_words(text)
    if len(w) < SHINGLE:
        return Counter([tuple(w)] if w else [])
    return Counter(zip(*(w[i:] for i in range(SHINGLE))))


def similarity(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(y) < len(x):
        x, y = y, x
    both = sum(min(c, y[k]) for k, c in x.items() if k in y)
    total = x.total() + y.total() - both
    return both / total if total else 0.0


def _verify_rows(threshold: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for rb in batches:
            a, b, s = [], [], []
            for c, salt, kind, doc_id, text in zip(*(x.to_pylist() for x in rb.columns)):
                if (c, salt) != key:
                    key, centres = (c, salt), []
                counts = shingle_counts(text)
                if kind == 0:
                    centres.append(counts)
                    continue
                best = max((similarity(x, counts) for x in centres), default=0.0)
                if best >= threshold:
                    a.append(c)
                    b.append(doc_id)
                    s.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return apply


def verify(space: Workspace, docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity of (centre, member) pairs; only links at the threshold stay."""
    per = space.save(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_COPY).cast("int").alias("copies")), "copies")
    members = pairs.join(per, "centre").select(F.col("member").alias("doc_id"), "centre", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    centres = per.select(F.col("centre").alias("doc_id"), "centre", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"))
    rows = docs.join(members.unionByName(centres).hint("merge"), "doc_id").select("centre", "salt", "kind", "doc_id", "text")
    rows = rows.repartition(task_count(docs.sparkSession), "centre", "salt").sortWithinPartitions("centre", "salt", "kind")
    return rows.mapInArrow(_verify_rows(threshold), "a long, b long, similarity double")


def components(space: Workspace, links: DataFrame, name: str) -> DataFrame:
    """``id, class``: the least id that is reachable over the links (a, b).

    Labels move along links and are then shortened by one jump, so long chains take a
    logarithmic number of rounds; each round is a written table.
    """
    both = space.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = space.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("m"))
        moved = labels.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "m").alias("class"))
        jump = labels.select(F.col("id").alias("class"), F.col("class").alias("root"))
        moved = moved.join(jump, "class", "left").select("id", "was", F.least("class", "root").alias("class"))
        seen = Observation()
        moved = space.save(moved.observe(seen, F.count_if(F.col("was") != F.col("class")).alias("changed")), f"{name}-{turn + 1}")
        space.drop(f"{name}-{turn}")
        labels, turn = moved.select("id", "class"), turn + 1
        if not seen.get["changed"]:
            space.drop(f"{name}-edges")
            return labels


def star_classes(space: Workspace, links: DataFrame) -> DataFrame:
    """``id, class`` of the links (a: centre, b: member).

    A member keeps its least centre, and the centres that it links are joined with
    that one; so only centres enter the rounds of ``components``, however many members
    they have. A member has one centre a band at most.
    """
    firsts = space.save(links.groupBy("b").agg(F.min("a").alias("first"), F.collect_set("a").alias("centres")), "firsts")
    centres = links.select(F.col("a").alias("b")).distinct()
    edges = firsts.select("first", F.explode("centres").alias("b")).where("first <> b").union(firsts.join(centres, "b", "left_semi").select("first", "b"))
    roots = components(space, space.save(edges.select(F.col("first").alias("a"), "b").distinct(), "centre-links"), "centres")
    rows = firsts.select(F.col("b").alias("id"), "first").union(centres.select(F.col("b").alias("id"), F.col("b").alias("first")))
    rows = space.save(rows.join(roots.select(F.col("id").alias("first"), "class"), "first", "left").select("id", F.coalesce("class", "first").alias("root")).distinct(), "rooted")
    least = space.save(rows.groupBy("root").agg(F.min("id").alias("class")), "least")
    labels = space.save(rows.join(least, "root").select("id", "class"), "labels-0")
    space.drop("firsts", "centre-links", "rooted", "least")
    return labels


def moved_classes(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """``labels`` after classes have moved; ``moves`` (id, class) also has texts that were alone."""
    known = labels.join(moves.select(F.col("id").alias("class"), F.col("class").alias("to")), "class", "left").select("id", F.coalesce("to", "class").alias("class"))
    return known.union(moves.join(labels, "id", "left_anti").select("id", "class"))


def _block_rows(threshold: float):
    """Pairs of linked classes inside the units (bucket, block i, block j) that arrive one after another."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, bands, root, names = None, [], None, {}, {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        for rb in batches:
            a, b = [], []
            for band, key, i, j, block, cls, keys, text in zip(*(x.to_pylist() for x in rb.columns)):
                if (band, key, i, j) != unit:
                    unit, held, bands, root, names = (band, key, i, j), [], np.zeros((BLOCK, band + 1), np.int64), {}, {}
                # the n-th occurrence of a shingle has a number of its own, so multisets are sets of numbers
                own = np.array(keys[: band + 1])
                counts = {names.setdefault((k, n), len(names)) for k, c in shingle_counts(text).items() for n in range(c)}
                total = len(counts)
                if i == j or block == j:
                    earlier = (bands[: len(held), :band] == own[:band]).any(axis=1)
                    for k in np.flatnonzero(~earlier):
                        its, n, c = held[k]
                        if min(n, total) < threshold * max(n, total) or find(its) == find(cls):
                            continue
                        both = len(c & counts)
                        if both < threshold * (n + total - both):
                            continue
                        a.append(min(its, cls))
                        b.append(max(its, cls))
                        root[find(its)] = find(cls)
                if block == i:
                    if len(held) == len(bands):
                        bands = np.concatenate([bands, np.zeros_like(bands)])
                    bands[len(held)] = own
                    held.append((cls, total, counts))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return apply


def verify_blocks(docs: DataFrame, members: DataFrame, threshold: float, turn: int, diagonal: bool) -> DataFrame:
    """Linked classes (a, b), the lesser first, of ``members``: band, key, n, rep, class, bands.

    A bucket is dealt into blocks by a hash that depends on ``turn``; ``diagonal``
    compares each block in itself, else every block with every other. A pair that
    agrees in an earlier one of ``bands`` is skipped, for it is compared there.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(turn)), blocks).cast("int")
    rows = members.withColumn("block", block)
    if diagonal:
        rows = rows.withColumn("other", F.col("block"))
    else:
        others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: x != F.col("block"))
        rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("rep").alias("doc_id"), "class", "bands")
    rows = docs.join(rows.hint("merge"), "doc_id").select("band", "key", "i", "j", "block", "class", "bands", "text")
    rows = rows.repartition(task_count(docs.sparkSession), "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "block", "class")
    return rows.mapInArrow(_block_rows(threshold), "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, copy_of`` for every row: the least doc_id of its class, and of its equal texts."""
    space = Workspace(docs.sparkSession, "bagminhash")
    text = text_of(docs, text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sketches = docs.select("doc_id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("h"), "text").mapInArrow(_sketch_rows, "doc_id long, h binary, bands array<long>")
    sketches = space.save(sketches, "sketches")
    reps = space.save(sketches.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "reps")
    rows = reps.where("rep is not null").select("rep", F.posexplode("bands").alias("band", "key")).select("band", "key", "rep", F.xxhash64("rep", "band").alias("o"))
    centres = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "rep")).alias("c")).where("n > 1")
    centres = space.save(centres, "centres")
    members = space.save(rows.join(centres, ["band", "key"]).where("o > c.o").select("band", "key", "n", F.col("c.rep").alias("centre"), "rep"), "members")
    space.drop("centres")
    pairs = space.save(members.select("centre", F.col("rep").alias("member")).distinct(), "pairs")
    # the texts that share a band at all, so that later steps do not shuffle the whole corpus again
    wanted = members.select(F.col("rep").alias("doc_id")).union(members.select(F.col("centre").alias("doc_id"))).distinct()
    texts = space.save(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    links = space.save(verify(space, texts, pairs, threshold).select("a", "b").distinct(), "star-links")
    labels = star_classes(space, links)
    space.drop("pairs", "copies", "star-links")
    # members that were no centres, in buckets where they are of several classes; two rounds compare
    # within blocks, so that classes grow, and the last one all blocks of the buckets still open
    rest = members.where("n > 2").select("band", "key", "n", "rep")
    small = members.where(F.col("n").between(3, BLOCK)).groupBy("rep", "band").agg(F.min("key").alias("key"))  # one of them where an id has several texts
    small = small.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("small"))
    small = space.save(small, "small")  # a text's buckets of one block, which the first round settles
    for turn in range(ROUNDS + 1):
        diagonal = turn < ROUNDS
        if turn:
            rest = rest.where(F.col("n") > BLOCK)
        rest = rest.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("band", "key", "n", "rep", F.coalesce("class", "rep").alias("class"))
        rest = space.save(rest, f"rest-{turn}")
        several = space.save(rest.groupBy("band", "key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("band", "key"), f"several-{turn}")
        rest = rest.join(several, ["band", "key"])
        if diagonal:
            done = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.coalesce(F.try_element_at("small", i), F.xxhash64("rep", i)))
            rest = rest.join(small, "rep", "left").withColumn("bands", done).drop("small")
        else:
            rest = rest.join(reps.select("rep", "bands"), "rep")
        rest = space.save(rest, f"open-{turn}")
        space.drop(f"rest-{turn}", f"several-{turn}", f"open-{turn - 1}")
        if rest.isEmpty():
            break
        more = space.save(verify_blocks(texts, rest, threshold, min(turn, ROUNDS - 1), diagonal), f"block-links-{turn}")
        if not more.isEmpty():
            moves = components(space, more, f"moves-{turn}")
            old, labels = f"labels-{turn}", space.save(moved_classes(labels, moves), f"labels-{turn + 1}")
            space.drop(old)
        else:
            labels = space.save(labels, f"labels-{turn + 1}")
        space.drop(f"block-links-{turn}")
        rest = rest.drop("class", "bands")
    space.drop("members", "small", "texts")
    out = sketches.select("doc_id", "h").join(reps.select("h", "rep"), "h")
    return out.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"), F.col("rep").alias("copy_of"))


def op9_near(spark, sf_dir: str) -> DataFrame:
    """Query: the near-duplicate class of every document."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
