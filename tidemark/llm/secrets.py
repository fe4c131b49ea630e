"""Secret scan: base patterns and the token-efficiency test.

A random string needs many tokens of a byte-level BPE vocabulary for its length.
Long runs of key characters whose characters-per-token ratio is low are spans of
kind ``random``, after known digests and identifiers are excluded. An identifier is a run
whose parts between separators have a high ratio of their own, so the ratio decides on
names as well: words joined by dashes pass, random groups joined by dashes do not, however
short. In URLs the dotted host name, which is an identifier, is left out, while userinfo
and the rest are tested: each run as a whole, else segment by segment. The scan is a single pass over whole texts without a
shuffle, and linear in a text.

Defined results: a null text counts as empty and has no spans; repeated rows get
the same spans; of spans that share a start the kind listed first comes first; the longest
text is scanned as a whole; an empty table gives an empty result. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: What follows ``://`` in a URL, and a run between its slashes and equal signs.
URL_REST = re.compile(r"""[^\s"'`<>(){}\[\]|\\^,;]*""")
SEGMENT = re.compile(r"[A-Za-z0-9+_-]{20,}")
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
#: Parts of a run up to this length tell little about it.
SHORT_PART = 3
#: The pre-split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs and numbers."""
    return bool(HEXADECIMAL.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run)) or not any(c.isalpha() for c in run)


def identifier_parts(run: str) -> list[str]:
    """The parts of a run between its separators and numbers.

    Short ones count only where they hold more than half of its letters and digits, as in
    a licence key or a name of short words.
    """
    parts = re.split(r"[+/_=-]+|(?<![A-Za-z])[0-9]+(?![A-Za-z])|(?<=[a-z]{2})[0-9]{1,4}(?![A-Za-z0-9])", run)
    long_parts = [x for x in parts if len(x) > SHORT_PART]
    return long_parts if 2 * sum(map(len, long_parts)) >= sum(c.isalnum() for c in run) else [x for x in parts if x]


def ratio(parts: list[str], vocabulary: str) -> float:
    """Characters per token of some strings together; endless without any."""
    tokens = sum(len(encoder(vocabulary).encode_ordinary(x)) for x in parts)
    return sum(map(len, parts)) / tokens if tokens else float("inf")


class Cover:
    """Whether a base span covers a range; spans in order of their starts."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts, self.ends = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def url_parts(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, start of the host, end of the host, end) of what follows each ``://``; an undotted host is empty."""
    at = text.find("://")
    while at >= 0:
        a, b = at + 3, URL_REST.match(text, at + 3).end()
        end = min((x for x in (text.find(c, a, b) for c in "/?#") if x >= 0), default=b)
        host = max(a, text.rfind("@", a, end) + 1)
        yield a, host, end if "." in text[host:end] else host, b
        at = text.find("://", b)


def efficient(run: str, vocabulary: str, max_ratio: float) -> bool:
    """Known strings, and runs with many characters a token, as a whole or in their parts."""
    return known(run) or ratio([run], vocabulary) >= max_ratio or ratio(identifier_parts(run), vocabulary) >= max_ratio


def random_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """Runs outside URLs with few characters a token that no base span covers."""
    found, at, cover = [], 0, Cover(base)
    for start, end in [*((a, b) for a, _, _, b in url_parts(text)), (len(text), len(text))]:
        for m in RUN.finditer(text, at, start):
            a, b = m.span()
            if not cover.holds(a, b) and not efficient(m.group(), vocabulary, max_ratio):
                found.append((a, 3, b))
        at = end
    return found


def url_spans(text: str, base: list[tuple[int, int, int]], vocabulary: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """The same for the userinfo, path, query and fragment of URLs."""
    found, cover = [], Cover(base)
    for start, host, host_end, end in url_parts(text):
        for at, part in ((start, text[start:host]), (host_end, text[host_end:end])):
            for m in RUN.finditer(part):
                whole = not efficient(m.group(), vocabulary, max_ratio)
                for a, b in [m.span()] if whole else [x.span() for x in SEGMENT.finditer(part, *m.span()) if not efficient(x.group(), vocabulary, max_ratio)]:
                    if not cover.holds(at + a, at + b):
                        found.append((at + a, 3, at + b))
    return found


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by a mark; unchanged without spans."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = 2.0, redacted: bool = False) -> DataFrame:
    """``docs`` with the columns of SCHEMA in a struct ``secrets``; ``redacted`` is null unless asked for."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base, vocabulary, max_ratio) + url_spans(text, base, vocabulary, max_ratio))
                said = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in xs)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "n_random": n[3], "base_sha256": hashlib.sha256(said(base).encode()).hexdigest(), "spans": said(spans), "redacted": redact(text, spans) if redacted and spans else None})
            yield pa.array(rows, KIND)

    KIND = pa.struct([(c, pa.int64() if t == "long" else pa.string()) for c, t in (x.split() for x in SCHEMA.split(", "))])
    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(scan, SCHEMA)
    return docs.withColumn("secrets", udf(docs[text_col].cast("string")))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Query: base counts, the digest of the base spans, and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_secrets(docs)
    return out.select("doc_id", *[F.col(f"secrets.{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")])
