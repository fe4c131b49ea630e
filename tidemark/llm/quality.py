"""Line-first cleaning with DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules, failing
lines are removed, and a document that loses too much text is rejected. All work
is done inside the row: no shuffle, no Python, so neither a hot source nor a very
long document concentrates on one task beyond its own bytes.

Defined results: a null text counts as empty; an empty text has no words and fails
the base rules; repeated rows are judged alike, and ties cannot arise; the longest text
is judged whole; other columns pass through, but for one named ``quality`` in any case, which the
result replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import SPACES, text_of, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
SENTENCE_END = "[.!?…。！？]"
#: A line ends well with an end mark, also before closing quotes or brackets.
END_MARKS = ".!?…:;。！？"
CLOSERS = "\"'”’»)]"
#: What a line of navigation begins with, in English, German, French and Spanish.
NAVIGATION_WORDS = (
    "home", "menu", "log ?in", "sign (in|up)", "read more", "click here", "next page", "previous page", "back to top", "share (this|on)", "skip to content", "subscribe",
    "startseite", "menü", "anmelden", "weiterlesen", "mehr lesen", "nächste seite", "zum inhalt", "nach oben", "accueil", "connexion", "lire la suite", "page suivante", "aller au contenu",
    "inicio", "menú", "iniciar sesión", "leer más", "página siguiente", "ir al contenido",
)
NAVIGATION = f"(?i)^[ \\t-\\r]*({'|'.join(NAVIGATION_WORDS)})(\\P{{L}}|$)"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "use cookies", "uses cookies", "terms of use", "terms of service", "copyright (c)", "copyright ©", "lorem ipsum", "enable javascript", "licensed under",
    "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "nutzungsbedingungen", "tous droits réservés", "politique de confidentialité", "utilise des cookies", "conditions d'utilisation",
    "todos los derechos reservados", "política de privacidad", "utiliza cookies", "términos de uso",
)
#: A line of this many words is boilerplate for one phrase, a longer one for as many phrases more.
PHRASE_WORDS = 40
PHRASES = "|".join(x.replace("(", "\\(").replace(")", "\\)") for x in BOILERPLATE)


def count_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def has_word(text: Column) -> Column:
    return text.rlike("[^ \\t-\\r]")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    A first pass sorts 32-bit window hashes with their positions in one long array;
    only windows whose hash occurs twice are then compared as strings.
    """
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.transform(starts, lambda i: F.shiftleft(F.hash(*window(i)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(i.cast("long")))


def quality_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts in ``__q_*`` columns."""
    pos = F.lit(2**31 - 1)
    twice = lambda arr, key: F.filter(arr, lambda x, j: F.coalesce(key(F.get(arr, j + 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(arr, j - 1)) == key(x), F.lit(False)))
    df = docs.withColumn("__q_text", text_of(docs, text_col))
    df = df.withColumns({"__q_words": words_of(F.col("__q_text")), "__q_lines": F.split("__q_text", "\n", -1)})
    df = df.withColumn("__q_packed", F.sort_array(repeated_words(F.col("__q_words"))))
    df = df.withColumn("__q_maybe", F.transform(twice(F.col("__q_packed"), lambda x: F.shiftright(x, 31)), lambda x: x.bitwiseAND(pos).cast("int")))
    w = F.col("__q_words")
    df = df.withColumn("__q_keys", F.sort_array(F.transform("__q_maybe", lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")))))
    df = df.withColumn("__q_again", twice(F.col("__q_keys"), lambda x: x["k"]))
    df = df.withColumn("__q_full", F.filter("__q_lines", has_word))
    return df.withColumns(
        {
            "__q_n_words": F.size("__q_words").cast("long"),
            "__q_word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
            "__q_n_symbols": count_of(F.col("__q_text"), SYMBOLS).cast("long"),
            "__q_n_dup_lines": (F.size("__q_full") - F.size(F.array_distinct("__q_full"))).cast("long"),
            "__q_n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform("__q_again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long"),
        }
    ).drop("__q_packed", "__q_maybe", "__q_keys", "__q_again", "__q_full")


def phrases_in(low: Column) -> Column:
    """How many phrases of boilerplate a text in lower case holds; the pattern runs only where one is sure to be found."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return F.when(found, F.regexp_count(low, F.lit(PHRASES))).otherwise(0)


def line_verdicts(lines: Column) -> Column:
    """For each line its characters in words, and whether it breaks a rule.

    The cheap counts and the lower case are bound once for each line. A line is
    boilerplate if it has a phrase for every PHRASE_WORDS words, or part of them: prose
    that mentions a policy once in a long line is none.
    """
    facts = F.transform(
        F.transform(lines, lambda x: F.struct(x.alias("x"), words_of(x).alias("words"), F.lower(x).alias("low"))),
        lambda s: F.struct(
            F.length(F.array_join(s["words"], "")).alias("chars"),
            F.size(s["words"]).alias("words"),
            count_of(s["x"], "#*$%&<>").alias("symbols"),
            count_of(s["x"], "!?").alias("shouts"),
            count_of(s["x"], SEPARATORS).alias("marks"),
            F.substring(F.rtrim(F.rtrim(s["x"], F.lit(SPACES)), F.lit(CLOSERS)), -1, 1).alias("last"),
            phrases_in(s["low"]).alias("phrases"),
            s["x"].alias("x"),
        ),
    )

    def fails(s: Column) -> Column:
        symbols = (10 * s["symbols"] > 3 * s["words"]) | (10 * s["shouts"] > 5 * F.greatest(s["words"], F.lit(4)))
        unended = ~(F.contains(F.lit(END_MARKS), s["last"]) & (s["last"] != "")) & ~s["x"].rlike(SENTENCE_END)
        menu = ((s["marks"] >= 2) & (3 * s["marks"] >= s["words"])) | ((s["words"] <= 8) & s["x"].rlike(NAVIGATION))
        phrase = (s["phrases"] > 0) & (PHRASE_WORDS * s["phrases"] >= s["words"])
        return (s["chars"] > 0) & (symbols | menu | unended | phrase)

    return F.transform(facts, lambda s: F.struct(s["chars"].alias("chars"), fails(s).alias("bad"), s["x"].alias("x")))


def clean_lines(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_lines, lost_chars, clean_text, kept`` in a struct column ``quality``.

    ``kept`` is false for base failures and for documents whose failing lines hold
    more than ``max_lost_percent`` of the characters in words. Where no line fails,
    ``clean_text`` is the text itself.
    """
    df = quality_features(docs, text_col)
    df = df.withColumn("__q_verdicts", line_verdicts(F.col("__q_lines")))
    df = df.withColumn("__q_bad", F.filter("__q_verdicts", lambda s: s["bad"]))
    df = df.withColumn("__q_lost", F.aggregate("__q_bad", F.lit(0).cast("long"), lambda a, s: a + s["chars"]))
    kept_lines = F.transform(F.filter("__q_verdicts", lambda s: ~s["bad"]), lambda s: s["x"])
    failed = (F.col("__q_n_words") < min_words) | (100 * F.col("__q_n_repeat_words") > max_repeat_percent * F.col("__q_n_words"))
    verdict = 100 * F.col("__q_lost") <= max_lost_percent * F.col("__q_word_chars")
    quality = F.struct(
        *[F.col(f"__q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        F.size("__q_bad").cast("long").alias("n_removed_lines"),
        F.col("__q_lost").alias("lost_chars"),
        F.when(F.size("__q_bad") > 0, F.array_join(kept_lines, "\n")).otherwise(F.col("__q_text")).alias("clean_text"),
        (~failed & verdict).alias("kept"),
    )
    return df.select(*[docs[c] for c in docs.columns if c.lower() != "quality"], quality.alias("quality"))


def kept_documents(docs: DataFrame, **rules) -> DataFrame:
    """The kept rows of ``clean_lines``, each line's verdict computed once.

    The optimizer would push the verdict below the steps that compute it and write
    each step out again wherever it is used; the row number keeps it above them.
    """
    df = clean_lines(docs, **rules).withColumn("__q_row", F.monotonically_increasing_id())
    return df.where("quality.kept and __q_row >= 0").drop("__q_row")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Query: the base counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = clean_lines(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names], F.col("quality.n_removed_lines").alias("n_removed_lines"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
x AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM again) GROUP BY doc_id),
l AS (
  SELECT doc_id, x AS line, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
    length(x) - length(translate(x, '#*$%&<>', '')) AS syms,
    length(x) - length(translate(x, '!?', '')) AS shouts,
    length(x) - length(translate(x, '|»›•·', '')) AS seps,
    len(regexp_extract_all(lower(x), '{PHRASES}')) AS phrases
  FROM (SELECT doc_id, unnest(ls) AS x FROM w)
), lv AS (
  SELECT doc_id, line, chars, chars > 0 AND (
    (NOT regexp_matches(right(rtrim(rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '"''”’»)]'), 1), '[.!?…:;。！？]') AND NOT regexp_matches(line, '[.!?…。！？]'))
    OR 10 * syms > 3 * words OR 10 * shouts > 5 * greatest(words, 4)
    OR (seps >= 2 AND 3 * seps >= words)
    OR (regexp_matches(line, '(?i)^[\x20\x09-\x0D]*({NAVIGATION})(\P{L}|$)') AND words <= 8)
    OR (phrases > 0 AND 40 * phrases >= words)) AS bad
  FROM l
), lines AS (
  SELECT doc_id, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, count(*) FILTER (bad) AS n_bad,
    count(*) FILTER (chars > 0) - count(DISTINCT CASE WHEN chars > 0 THEN line END) AS dups FROM lv GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, lost, n_bad
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept,
  n_bad::BIGINT AS n_removed_lines
FROM base
""".replace("{NAVIGATION}", "|".join(NAVIGATION_WORDS)).replace("{PHRASES}", PHRASES.replace("'", "''"))
