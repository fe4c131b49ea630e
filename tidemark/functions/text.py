"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of file kinds in order of precedence, and of sections.
KINDS = (
    ("ANSWER_KEY", "ANSWER|정답"),
    ("TRANSCRIPT", "TRANSCRIPT|LISTENING TEXT|듣기\\s*대본|듣기\\s*텍스트"),
    ("QUESTIONS", "TEST PAPER|QUESTION|문제지|기출\\s*문제"),
)
SECTIONS = (("READING", "READING|읽기"), ("LISTENING", "LISTENING|듣기"), ("WRITING", "WRITING|쓰기"))
HANGUL_BEFORE, HANGUL_AFTER = "[가-힣)\\]]", "[가-힣(]"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", "")


def level_of(text: Column, series: str) -> Column:
    """I or II after the name of an exam series, or null."""
    t = F.upper(collapse(text))
    t = F.replace(F.replace(t, F.lit(f"{series}Ⅰ"), F.lit(f"{series} I")), F.lit(f"{series}Ⅱ"), F.lit(f"{series} II"))
    m = F.regexp_extract(t, f"\\b{series}\\s*(II|I|2|1)\\b", 1)
    return F.when(m.isin("II", "2"), "II").when(m.isin("I", "1"), "I")


def file_kind(text: Column, kinds=KINDS) -> Column:
    """The first kind whose keywords occur."""
    out = F.lit("UNCLASSIFIED")
    for name, pattern in reversed(kinds):
        out = F.when(F.upper(text).rlike(pattern), name).otherwise(out)
    return out


def file_section(text: Column, sections=SECTIONS) -> Column:
    """All sections whose keywords occur, joined."""
    found = F.array_join(F.filter(F.array(*[F.when(F.upper(text).rlike(p), n) for n, p in sections]), lambda x: x.isNotNull()), "_")
    return F.when(found == "", "COMBINED_OR_UNKNOWN").otherwise(found)


def unique_filename(series: str, session: Column, level: Column, section: Column, kind: Column, n: Column) -> Column:
    return F.format_string(f"{series}_%03d_%s_%s_%s_%02d.pdf", session, level, section, kind, n)


def space_punctuation(text: Column, before: str = HANGUL_BEFORE, after: str = HANGUL_AFTER) -> Column:
    """A space after a full stop or comma between letters of the given classes; idempotent."""
    return F.regexp_replace(text, f"(?<={before})([.,])(?={after})", "$1 ")


def space_speakers(text: Column, speakers: tuple[str, ...] = ("남자", "여자")) -> Column:
    """``label: `` at line starts, and a space between ? or ! and a following letter."""
    t = F.regexp_replace(text, f"(?m)^({'|'.join(speakers)})\\s*:\\s*", "$1: ")
    return F.regexp_replace(t, "(?<=[?!])(?=[가-힣])", " ")


#: What ends a line, and what is stripped from its ends.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
EDGES = "^[\\s\\p{Z}\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x1c-\\x1f\\x85]+$"
SPEAKERS = ("남자", "여자")


def dialogue(text: Column, speakers: tuple[str, ...] = SPEAKERS) -> Column:
    """Stripped, non-blank lines from the first speaker's line on; empty without a speaker."""
    lines = F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(x, EDGES, ""))
    at = F.array_position(F.transform(lines, lambda x: x.rlike(f"^({'|'.join(speakers)})(?U:\\s)*:")), True)
    kept = F.filter(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(1))), lambda x: x != "")
    return F.when(at > 0, F.array_join(kept, "\n")).when(text.isNotNull(), "")


# --- small scalars -----------------------------------------------------------------------

CIRCLED = "①②③④"


def plain_digits(text: Column) -> Column:
    """Circled digits as plain ones."""
    return F.translate(text, CIRCLED, "1234")


def padded_id(*parts: Column, digits: int = 3) -> Column:
    """Parts joined by dashes; numbers are padded with zeros and never cut."""
    return F.concat_ws("-", *[F.format_string(f"%0{digits}d", p) if i == len(parts) - 1 else p for i, p in enumerate(parts)])


def between_marks(text: Column, first: str, last: str) -> Column:
    """What stands after the last ``first`` and before the next ``last``; null where either is missing."""
    tail = F.substring_index(text, first, -1)
    return F.when(text.contains(first) & text.contains(last), F.substring_index(tail, last, 1))


def is_hex_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}\\z")


def matches_id(text: Column, prefix: str) -> Column:
    """A section letter and three digits after the prefix."""
    return text.rlike(f"^{prefix}-[LR]-[0-9]{{3}}\\z")


def safe_path(path: Column) -> Column:
    """Relative, without backslashes, drive letters, empty parts or steps upwards."""
    parts = F.split(path, "/")
    return ~path.startswith("/") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda x: x.isin("", ".", ".."))


def without_root(path: Column, root: str) -> Column:
    return F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 2**31 - 1)).otherwise(path)


def plain_default(text: Column) -> Column:
    """A column default without type casts and outer brackets."""
    bare = F.regexp_replace(F.trim(text), "::[A-Za-z_ ]+(\\([0-9, ]*\\))?", "")
    return F.trim(F.regexp_replace(bare, "^\\((.*)\\)$", "$1"))


def magic(data: Column) -> Column:
    """The kind of a binary by its first bytes."""
    head = lambda n: F.substring(data, 1, n)
    is_ = lambda n, hexed: head(n) == F.unhex(F.lit(hexed))
    return F.when(is_(8, "89504E470D0A1A0A"), "png").when(is_(5, "255044462D"), "pdf").when(is_(3, "494433") | (is_(1, "FF") & F.substring(F.hex(head(2)), 3, 1).isin("E", "F")), "mp3")


def whole_pdf(data: Column) -> Column:
    """The signature in front and the trailer in the last 2048 bytes."""
    tail = F.substring(data, -2048, 2048)
    return (magic(data) == "pdf") & F.coalesce(F.locate("2525454F46", F.hex(F.when(F.octet_length(data) > 2048, tail).otherwise(data))) > 0, F.lit(False))


def data_uri(text: Column, kind: str = "image/png") -> tuple[Column, Column]:
    """(bytes, fault) of a base64 data URI of the kind that must hold a PNG of 40 bytes or more."""
    head = f"data:{kind};base64,"
    body = F.substring(text, len(head) + 1, 2**31 - 1)
    strict = body.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\\z")
    data = F.when(text.startswith(head) & strict, F.try_to_binary(body, F.lit("base64")))
    fault = F.when(~text.startswith(head), "scheme").when(data.isNull(), "base64").when(~F.coalesce(magic(data) == "png", F.lit(False)), "signature").when(F.octet_length(data) < 40, "too_short")
    return data, fault


def length_and_digest(data: Column) -> Column:
    """A binary as its length and SHA-256."""
    return F.to_json(F.struct(F.octet_length(data).alias("len"), F.sha2(data, 256).alias("sha256")))


def duration_ms(text: Column) -> Column:
    """``HH:MM:SS.f`` after the word Duration, in milliseconds."""
    part = lambda i: F.regexp_extract(text, "Duration:\\s*([0-9]+):([0-9]{2}):([0-9]{2}(?:\\.[0-9]+)?)", i)
    seconds = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")
    return F.bround(seconds * 1000).cast("long")


def before_after(changes: dict[str, tuple[Column, Column]]) -> Column:
    """JSON of the fields that differ, each with its value before and after; null where none does."""
    each = F.array(*[F.when(~old.eqNullSafe(new), F.struct(F.lit(name).alias("key"), F.struct(old.alias("before"), new.alias("after")).alias("value"))) for name, (old, new) in changes.items()])
    kept = F.filter(each, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(kept), {"ignoreNullFields": "false"}))


def differing_fields(a: str, b: str, names: tuple[str, ...]) -> Column:
    """The names of the fields in which two structs differ."""
    return F.filter(F.array(*[F.when(~F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")), n) for n in names]), lambda x: x.isNotNull())


def pixel_rows(data: Column, stride: int, first: Column | int, rows: Column | int) -> Column:
    """Whole rows of an uncompressed image."""
    at = first if isinstance(first, Column) else F.lit(first)
    n = rows if isinstance(rows, Column) else F.lit(rows)
    return F.substring(data, at * stride + 1, n * stride)


def utc_seconds(ts: Column) -> Column:
    """An instant as UTC text to the second."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
