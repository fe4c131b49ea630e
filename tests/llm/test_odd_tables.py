"""Every registered query on tables of odd rows, and on empty ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries

LONG = "word " * 20000
GOOD = ". ".join(" ".join(f"{'bcdfgklm'[k]}o{i * 8 + k}" for k in range(8)) for i in range(12)) + "."
DOCUMENTS = [
    (None, None, None, None, None), (None, GOOD, "en", "a", None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, GOOD, "en", "a", 5), (3, GOOD, "en", "a", 5), (3, GOOD.replace("o12", "x"), None, None, None),
    (4, LONG, "en", "b", 1), (5, "z" * 30000, "xx", "b", 1), (6, "日本語のテキスト 🎉 \x1f\x85 text", "ja", "b", 1), (2**62, GOOD + " More.", "en", "c", 1), (-5, "idiot. " + GOOD, "en", "c", 1),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder of odd tables, folder of empty ones); extra columns clash with the operators' own names."""
    folders = []
    for name in ("odd", "empty"):
        d = str(tmp_path_factory.mktemp(name))
        docs = spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
        labels = spark.createDataFrame([(3, 1, 0), (-5, 0, 1), (None, 1, 1), (4, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://e.org/").alias("url"), F.col("text").alias("html"))
        for c in ("key", "bucket", "tag", "class", "rep", "g", "size", "quality", "secrets", "pieces", "text_crc32"):
            docs = docs.withColumn(c, F.lit("x"))
        items = spark.createDataFrame([(None, GOOD), (1, None), (2, ""), (3, "日本語のテキスト"), (3, GOOD[:80]), (3, GOOD[:80]), (4, "word word"), (5, LONG)], "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("w", F.lit("x"))
        for table, df in (("documents", docs), ("labels", labels), ("pages", pages), ("benchmark", items)):
            (df if name == "odd" else df.where("false")).write.parquet(f"{d}/{table}.parquet")
        folders.append(d)
    return folders


#: Queries whose rows are no documents.
OTHER_ROWS = ("op11_variants", "op12_search")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    odd, empty = tables
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == len(DOCUMENTS) or name in OTHER_ROWS
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_next_documents_of_odd_ids(spark, tables):
    """Descending ids, equal ones by text, null ones last, and after the last the first."""
    rows = [(i, t or "") for i, t, *_ in DOCUMENTS]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = sorted((str(i), len(t), t[: len(t) - len(t) // 3] + after[: len(t) // 3]) for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]))
    import hashlib

    got = queries.QUERIES["op8_fingerprints"](spark, tables[0]).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in want)


def test_pipeline(spark, tables):
    odd, empty = tables
    kept = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in kept} <= {None, 3, 2**62, -5} and kept
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op11_variants", "op12_search", "op13_decontamination"])
def test_sql_of_odd_tables(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from read_parquet('{tables[0]}/{table}.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, tables[0]), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
