"""JSON helpers whose bytes must be stable: canonical form, identity and fingerprints."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that make an identity out of a finding's evidence where none is given.
IDENTITY_KEYS = ("field", "observed", "expected")
LONGEST_IDENTITY, LONGEST_EVIDENCE = 10_000, 20_000


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical(value) -> str:
    """Sorted keys, no spaces, no escapes beyond JSON's own; floats stay floats."""
    return _ENCODER.encode(value)


def over_strings(value, change: Callable[[str], str]):
    """The value with ``change`` applied to every string that is not a key."""
    stack, out = [(value, None, None)], [None]
    while stack:
        item, holder, at = stack.pop()
        if type(item) is str:
            made = change(item)
        elif type(item) is list:
            made = [None] * len(item)
            stack.extend((x, made, i) for i, x in enumerate(item))
        elif type(item) is dict:
            made = dict.fromkeys(item)
            stack.extend((x, made, k) for k, x in item.items())
        else:
            made = item
        if holder is None:
            out[0] = made
        else:
            holder[at] = made
    return out[0]


def plain_text(text: str) -> str:
    """Compatibility form, single spaces, case folded; short texts, which recur, are kept."""
    return _plain(text) if len(text) <= 100 else _plain.__wrapped__(text)


@lru_cache(4096)
def _plain(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def identity_of(finding) -> str | None:
    """The canonical identity of a finding; null where its evidence gives none or is too long."""
    if not isinstance(finding, dict):
        return None
    evidence, given = finding.get("evidence"), finding.get("identity")
    if given is None:
        whole = isinstance(evidence, dict) and all(k in evidence for k in IDENTITY_KEYS)
        given = {k: evidence[k] for k in IDENTITY_KEYS} if whole else evidence
    if not given or not isinstance(given, dict | list):
        return None
    said = canonical(over_strings(given, plain_text))
    # JSON writes no value longer than twice its repr, which is quicker to make
    short = 2 * len(repr(evidence)) <= LONGEST_EVIDENCE or len(canonical(evidence)) <= LONGEST_EVIDENCE
    return said if len(said) <= LONGEST_IDENTITY and short else None


def _each(f):
    def apply(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else f(json.loads(x))
            except ValueError:
                return None

        return pd.Series([one(x) for x in values], index=values.index, dtype=object)

    return apply


def canonical_json(col: Column) -> Column:
    """Canonical JSON of a JSON text; null where it does not parse."""
    return F.pandas_udf(_each(canonical), "string")(col)


def identity_json(col: Column) -> Column:
    return F.pandas_udf(_each(lambda x: canonical(over_strings(x, plain_text))), "string")(col)


def finding_identity(col: Column) -> Column:
    """The canonical identity of a finding's JSON text."""
    return F.pandas_udf(_each(identity_of), "string")(col)


def result_parts(col: Column) -> Column:
    """Of a result's JSON text, parsed once: its canonical JSON, and the canonical identities of its ``findings`` where they are a list."""

    def apply(texts: pa.Array) -> pa.Array:
        said, found = [], []
        for text in texts:
            value = whole = None
            try:
                if text.is_valid:
                    value = json.loads(text.as_py())
                    whole = canonical(value)
            except ValueError:
                pass
            said.append(whole)
            items = value.get("findings") if isinstance(value, dict) else None
            found.append([identity_of(x) for x in items] if isinstance(items, list) else None)
        return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(found, pa.list_(pa.string()))], ["canonical", "identities"])

    return F.arrow_udf(apply, "canonical string, identities array<string>")(col)


def json_string(col: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(col)), "(?s)^\\[(.*)\\]$", 1)


def fingerprint_of(subject: Column, identity: Column, category: Column | None = None) -> Column:
    """SHA-256 of subject and canonical identity; the older form also has the category."""
    head = F.lit('{"identity":') if category is None else F.concat(F.lit('{"category":'), json_string(category), F.lit(',"identity":'))
    return F.sha2(F.concat(head, identity, F.lit(',"subject_id":'), json_string(subject), F.lit("}")), 256)


def fingerprint(subject: Column, identity: Column, category: Column | None = None) -> Column:
    """The fingerprint of an identity that is not normalised yet."""
    return fingerprint_of(subject, identity_json(identity), category)


def pretty(value, encoding: str = "utf-8") -> str:
    """Indented JSON whose characters the given encoding can hold; others are escaped."""
    plain = json.dumps(value, ensure_ascii=False, indent=2)
    try:
        plain.encode(encoding)
    except UnicodeEncodeError:
        return json.dumps(value, ensure_ascii=True, indent=2)
    return plain
