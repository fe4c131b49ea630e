"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The model file is read by the sentencepiece library for its pieces and scores only;
the best segmentation is found here. Distinct words of a batch are grouped by length
and advance together: at each position the hashes of the substrings that end there
probe the sorted hashes of the pieces, hits are compared byte by byte in the piece
table, and a vectorised maximum over the candidate lengths stores the backpointers.
A code point that no piece covers becomes its byte pieces, or the unknown piece.

The path has the greatest sum of piece scores, with the shortest last piece on a tie.
That is SentencePiece's own result for unigram models. The scores of a BPE model are
merge ranks r = 0, -1, -2, ... and no log probabilities, so they are read as Zipf log
probabilities -ln(1 - r) - 6. The path can then differ from the one of the merge order
(the README has figures); the text that it decodes to is the same.

Defined results: a null text counts as empty and has no pieces; every text is encoded
whole, with one dummy prefix space as in the model; repeated rows get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import text_of
from tidemark.llm._tokens import batches_of, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A word is a run of spaces and what follows up to the next space; no piece has a space after another character.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bits of a piece hash that are looked up before the sorted hashes are searched.
FILTER = 2**20
#: Words of more code points go through the same recurrence one by one.
LONG = 512
MISSING = np.float64(-1e18)
#: Cost of a piece besides its rank, for models whose scores are merge ranks.
RANK_COST = 6.0


class Vocabulary:
    """Pieces by sorted hash, with their code points for the comparison of hits."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.score = np.array(scores, np.float64)
        ranks = sorted((-scores[i] for i in normal if scores[i] > -1e5))
        if len(ranks) > 1 and all(float(r).is_integer() for r in ranks):
            self.score = np.where(self.score > -1e5, -np.log1p(np.maximum(-self.score, 0)) - RANK_COST, -np.log1p(len(ranks)) - RANK_COST)
        low = min((float(self.score[i]) for i in normal), default=0.0)
        self.unknown_score = low - 10.0
        self.table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.lookup = {pieces[i]: i for i in normal}
        for n in range(1, self.longest + 1):
            ids = np.array([i for i in normal if len(pieces[i]) == n], np.int64)
            chars = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint32).reshape(len(ids), n)
            h = mix(prefix_sums(chars)[:, n]) if len(ids) else np.zeros(0, np.uint64)
            order = np.argsort(h)
            seen = np.zeros(FILTER, bool)
            seen[h & np.uint64(FILTER - 1)] = True
            self.table[n] = h[order], ids[order], chars[order], seen

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        kind = lambda i: "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal"
        return Vocabulary([sp.id_to_piece(i) for i in ids], [sp.get_score(i) if sp.get_score(i) > -1e8 else -1e5 for i in ids], [kind(i) for i in ids])

    def spell(self, char: str) -> list[int]:
        """Ids of a code point that no piece covers."""
        data = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]


def prefix_sums(chars: np.ndarray) -> np.ndarray:
    """rows x (n + 1) sums of (code point + 1) * BASE^position, modulo 2^64."""
    n = chars.shape[1]
    out = np.zeros((len(chars), n + 1), np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), axis=1, out=out[:, 1:])
    return out


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]))[:n]


def viterbi(chars: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(piece length, piece id or -1) of the best last piece at each end of equally long words."""
    rows, n = chars.shape
    best = np.full((n + 1, rows), MISSING)
    best[0] = 0.0
    size, piece = np.ones((n + 1, rows), np.int16), np.full((n + 1, rows), -1, np.int32)
    sums, shift = np.ascontiguousarray(prefix_sums(chars).T), powers(INVERSE, n)
    for end in range(1, n + 1):
        best[end] = best[end - 1] + vocab.unknown_score
        for length in range(1, min(vocab.longest, end) + 1):
            keys, ids, spelled, seen = vocab.table[length]
            if not len(keys):
                continue
            h = mix((sums[end] - sums[end - length]) * shift[end - length])
            hit = np.flatnonzero(seen[h & np.uint64(FILTER - 1)])  # few substrings are worth the search
            at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
            same = (keys[at] == h[hit]) & (spelled[at] == chars[hit, end - length : end]).all(axis=1)
            hit, at = hit[same], at[same]
            value = best[end - length, hit] + vocab.score[ids[at]]
            better = value > best[end, hit]
            hit, at, value = hit[better], at[better], value[better]
            best[end, hit], size[end, hit], piece[end, hit] = value, length, ids[at]
    return size, piece


def _one(word: str, vocab: Vocabulary) -> list[int]:
    """The same recurrence for one long word, with a window of ``longest`` scores."""
    n, get = len(word), vocab.lookup.get
    best, size, piece = np.full(n + 1, MISSING), np.ones(n + 1, np.int16), np.full(n + 1, -1, np.int32)
    best[0] = 0.0
    for end in range(1, n + 1):
        top, k, p = best[end - 1] + vocab.unknown_score, 1, -1
        for length in range(1, min(vocab.longest, end) + 1):
            i = get(word[end - length : end])
            if i is not None and best[end - length] + vocab.score[i] > top:
                top, k, p = best[end - length] + vocab.score[i], length, i
        best[end], size[end], piece[end] = top, k, p
    return _trace(word, size, piece, vocab)


def _trace(word: str, size: np.ndarray, piece: np.ndarray, vocab: Vocabulary) -> list[int]:
    out, end = [], len(word)
    while end:
        out.append([int(piece[end])] if piece[end] >= 0 else vocab.spell(word[end - 1]))
        end -= int(size[end])
    return list(chain.from_iterable(reversed(out)))


def encode_words(words: list[str], vocab: Vocabulary) -> list[list[int]]:
    out: list[list[int]] = [[]] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        if n > LONG:
            for i in at:
                out[i] = _one(words[i], vocab)
            continue
        chars = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
        for a in range(0, len(at), max(1, 2_000_000 // int(n))):
            b = a + max(1, 2_000_000 // int(n))
            size, piece = viterbi(chars[a:b], vocab)
            # all words of the group step back together
            end, ids = np.full(len(size[0]), n), []
            rows = np.arange(len(end))
            while (end > 0).any():
                live = end > 0
                got = np.where(live, piece[end, rows], -2)
                ids.append((got, end.copy()))
                end = np.where(live, end - size[end, rows], 0)
            got = np.array([g for g, _ in ids])
            known, count, steps = ((got >= 0) | (got == -2)).all(axis=0), (got > -2).sum(axis=0), len(got)
            for i, row, ok, c, r in zip(at[a:b].tolist(), got[::-1].T.tolist(), known.tolist(), count.tolist(), range(len(count))):
                row = row[steps - c :]
                if not ok:
                    ends = [int(e[r]) for _, e in ids[c - 1 :: -1]]
                    row = list(chain.from_iterable([x] if x >= 0 else vocab.spell(words[i][e - 1]) for x, e in zip(row, ends)))
                out[i] = row
    return out


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> list[np.ndarray]:
    """Piece ids of each text."""
    words = [WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = list(chain.from_iterable(words))
    if not len(flat):
        return [np.zeros(0, np.int32) for _ in texts]
    codes, uniques = pd.factorize(flat)
    ids = encode_words(list(uniques), vocab)
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    start = np.cumsum(size) - size
    pool = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
    per = size[codes]
    end = np.cumsum(per)
    index = np.arange(int(end[-1])) - np.repeat(end - per, per) + np.repeat(start[codes], per)
    all_ids = pool[index]
    cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(w) for w in words])])]
    return [all_ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of a sequence of ids; byte pieces are joined to code points."""
    raw = vocab_bytes(vocab)
    data = b"".join([raw[i] for i in ids.tolist()])
    text = data.decode("utf-8", "surrogatepass").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def vocab_bytes(vocab: Vocabulary) -> list[bytes]:
    if not hasattr(vocab, "raw"):
        vocab.raw = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.encode() for p, k in zip(vocab.pieces, vocab.kinds)]
    return vocab.raw


def _encoded(model: str, with_ids: bool):
    kind = pa.struct([("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = Vocabulary.load(model)
        for array in batches:
            texts, rows = array.to_pylist(), []
            for a, b in batches_of(texts):
                for text, ids in zip(texts[a:b], encode_texts(texts[a:b], vocab)):
                    rows.append({"n_pieces": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), "round_trip": decode_ids(ids, vocab) == (text or "").replace(SPACE, " "), "ids": ids if with_ids else None})
            yield pa.array(rows, kind)

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return apply


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """``docs`` with a struct ``pieces`` of ``n_pieces, ids_sha256, round_trip, ids``.

    ``round_trip`` compares the decoded ids with the text, where U+2581, which the
    format uses for the space, counts as a space.
    """
    udf = F.arrow_udf(_encoded(model, with_ids), "n_pieces long, ids_sha256 string, round_trip boolean, ids array<int>")
    return docs.withColumn("pieces", udf(text_of(docs, text_col)))


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the text of an array of ids in ``decoded``; null ids give null."""

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = Vocabulary.load(model)
        for array in batches:
            yield pa.array([None if x is None else decode_ids(np.array(x, np.int64), vocab) for x in array.to_pylist()], pa.string())

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("decoded", F.arrow_udf(apply, "string")(df[ids_col]))


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """Query: encode every document, decode it again, and return counts and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, with_ids=False)
    return out.select("doc_id", "pieces.n_pieces", "pieces.ids_sha256", "pieces.round_trip")
