"""Queries of scans and sinks: each writes real files to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import mutate
from tidemark.plans import exam, extract_catalog
from tidemark.plans.registry import query, table
from tidemark.sinks import appendlog, commits, loads
from tidemark.sinks import files as sinks
from tidemark.sources import bytes, files, links
from tidemark.streaming import ingest as stream

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@query("SELECT page_id::INT AS session, url AS source_page FROM pages")
def source_list(spark, d):
    path = files.scratch(spark, "sources")
    sinks.write_csv(table(spark, d, "pages").select(F.col("page_id").alias("session"), F.col("url").alias("source_page"), F.lit("a, \"b\"\nc").alias("source_type")), path)
    return files.source_list(spark, path)


@query("SELECT session::INT AS session, level, kind, section, label, url, source_page, 'indexed' AS status FROM iv", extract_catalog.PAGES)
def inventory_csv(spark, d):
    """The inventory written as CSV and read again."""
    path = files.scratch(spark, "inventory")
    sinks.write_csv(links.inventory(extract_catalog.pages(spark, d), "EXAM").select(*links.COLUMNS), path)
    back = files.read_csv(spark, path, "session int, " + ", ".join(f"{c} string" for c in links.COLUMNS[1:]))
    return back.select("session", "level", "kind", "section", "label", "url", "source_page", "status")


@query("SELECT (SELECT count(DISTINCT exam_id) FROM q) AS source_count, count(*) AS candidate_count, 0::BIGINT AS error_count FROM iv", extract_catalog.PAGES)
def collection_summary_json(spark, d):
    path = files.scratch(spark, "summary")
    p = extract_catalog.pages(spark, d)
    sinks.write_summary(links.collection_summary(links.inventory(p, "EXAM"), p.select("page_id")), path)
    return spark.read.schema("source_count long, candidate_count long, error_count long").json(path)


@query("""SELECT exam_id, CASE WHEN exam_id % 9 <> 3 THEN n END AS questions, CASE WHEN exam_id % 9 <> 3 THEN total END AS numbers, exam_id % 9 <> 5 AS has_groups FROM (SELECT exam_id, count(*) AS n, sum(number)::BIGINT AS total FROM q GROUP BY exam_id)""", exam.SQL)
def embedded_json(spark, d):
    """Constants of page scripts; some pages lack one, and some hold broken JSON."""
    q = exam.questions(spark, d).groupBy("exam_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("number", "stem")))).alias("j"))
    broken = F.when(F.expr("exam_id % 9 = 3"), F.concat("j", F.lit("]{"))).otherwise(F.col("j"))
    html = F.concat(F.lit("<script>\nconst QUESTIONS="), broken, F.lit(";  \nlet x=1;\n"), F.when(F.expr("exam_id % 9 = 5"), "").otherwise('const GROUPS=[{"a":"const X=1;"}];\n'), F.lit("</script>"))
    rows = q.select("exam_id", html.alias("html")).select("exam_id", F.from_json(files.embedded_json(F.col("html"), "QUESTIONS"), "array<struct<number:int,stem:string>>").alias("a"), files.embedded_json(F.col("html"), "GROUPS").isNotNull().alias("has_groups"))
    return rows.select("exam_id", F.size("a").cast("long").alias("questions"), F.aggregate("a", F.lit(0).cast("long"), lambda t, x: t + x["number"]).alias("numbers"), "has_groups")


REQUIRED = (("answer_key", "combined"), ("listening_audio", "combined"), ("listening_transcript", "combined"), ("test_paper", "combined"))


@query("""SELECT exam_id AS doc, CASE WHEN exam_id % 4 = 1 THEN 3 WHEN exam_id % 4 = 2 THEN 5 ELSE 4 END::BIGINT AS entries, CASE WHEN exam_id % 4 = 1 THEN 'answer_key/combined,listening_audio/combined,listening_transcript/combined' WHEN exam_id % 4 = 3 THEN 'answer_key/combined,listening_audio/combined,other/combined,test_paper/combined' ELSE 'answer_key/combined,listening_audio/combined,listening_transcript/combined,test_paper/combined' END AS keys, exam_id % 4 = 0 AS complete FROM (SELECT DISTINCT exam_id FROM q)""", exam.SQL)
def manifest_index(spark, d):
    """Manifests of every exam; a quarter each whole, one short, one twice, and one with another asset."""
    e = exam.questions(spark, d).select("exam_id").distinct()
    entry = lambda asset, level="I", session=None: F.concat(F.lit('{"session":'), (F.col("exam_id") if session is None else F.lit(session)).cast("string"), F.lit(f',"level":"{level}","asset":"{asset}","section":"combined","path":"p","sha256":"s","size_bytes":1}}'))
    k = F.expr("exam_id % 4")
    parts = F.concat_ws(",", entry("answer_key"), entry("listening_audio"), F.when(k == 3, entry("other")).otherwise(entry("listening_transcript")), F.when(k != 1, entry("test_paper")), F.when(k == 2, entry("test_paper")), entry("test_paper", "II"), entry("test_paper", "I", -1))
    m = e.select(F.col("exam_id").alias("doc"), F.concat(F.lit('{"entries":['), parts, F.lit("]}")).alias("raw"))
    return files.manifest_entries(m, F.col("doc"), "I", REQUIRED).withColumn("keys", F.array_join("keys", ","))


def _lines(spark, d):
    return exam.questions(spark, d).select("exam_id", "number", F.col("stem").alias("line"))


FILES = exam.SQL + """, fl AS (SELECT exam_id, string_agg(stem || chr(10), '' ORDER BY number) AS body FROM q GROUP BY exam_id)
"""


@query("SELECT exam_id::VARCHAR AS exam_id, octet_length(encode(body))::BIGINT AS size, sha256(body) AS sha256 FROM fl", FILES)
def file_hash_scan(spark, d):
    path = files.scratch(spark, "files")
    sinks.write_files(_lines(spark, d), "exam_id", "number", path)
    return bytes.file_hashes(spark, path, "*.txt").select(F.regexp_extract("path", "exam_id=([0-9]+)/", 1).alias("exam_id"), "size", "sha256")


@query("SELECT exam_id::VARCHAR AS exam_id, octet_length(encode(body))::BIGINT AS size, CASE WHEN octet_length(encode(body)) <= 2000 THEN body END AS body, CASE WHEN octet_length(encode(body)) > 2000 THEN 'file exceeds 2000 bytes' END AS error FROM fl", FILES)
def limited_files(spark, d):
    """Files up to a size are read whole, larger ones not at all."""
    path = files.scratch(spark, "limited")
    sinks.write_files(_lines(spark, d), "exam_id", "number", path)
    rows = bytes.limited_files(spark, path, 2000, "*.txt")
    return rows.select(F.regexp_extract("path", "exam_id=([0-9]+)/", 1).alias("exam_id"), "size", F.decode("content", "UTF-8").alias("body"), "error")


@query("SELECT page_id, url, sha256(html) AS html FROM pages WHERE html IS NOT NULL")
def csv_in_splits(spark, d):
    """Pages as CSV cells with line breaks and quotes, read in splits far smaller than a file."""
    path = files.scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "pages").where("html is not null").select("page_id", "url", "html"), path)
    rows = bytes.csv_records(spark, path, "page_id long, url string, html string", "*.csv", 256 << 10)
    return rows.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("html"))


@query("SELECT exam_id::VARCHAR AS exam_id, CASE exam_id % 5 WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'unexpected' ELSE 'same' END AS status FROM fl", FILES)
def archive_verify(spark, d):
    """A frozen archive against files of which some were changed, removed or added since."""
    root = files.scratch(spark, "archive")
    sinks.write_files(_lines(spark, d).where("exam_id % 5 <> 3"), "exam_id", "number", f"{root}/frozen")
    frozen = sinks.freeze(spark, f"{root}/frozen", f"{root}/manifest", "exam_id")
    now = _lines(spark, d).where("exam_id % 5 <> 2").withColumn("line", F.when(F.expr("exam_id % 5 = 1 and number = 1"), F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    sinks.write_files(now, "exam_id", "number", f"{root}/now")
    found = bytes.file_hashes(spark, f"{root}/now", "*.txt").select(F.regexp_extract("path", "exam_id=([0-9]+)/", 1).alias("exam_id"), "size", "sha256")
    return sinks.verify_archive(frozen, found, "exam_id")


@query("SELECT * FROM (VALUES ('first', 'published'), ('again', 'exists')) AS t(attempt, status), (SELECT count(*) AS rows FROM region)")
def publish_once(spark, d):
    path = files.scratch(spark, "publish")
    r = table(spark, d, "region")
    got = [("first", sinks.publish(r, path)), ("again", sinks.publish(r.limit(1), path))]
    n = spark.read.parquet(path).count()
    return spark.createDataFrame([(*x, n) for x in got], "attempt string, status string, rows long")


@query("""SELECT 'good' AS load, 'nation' AS "table", (SELECT count(*) FROM nation) AS rows, 0::BIGINT AS violations, 'loaded' AS status, (SELECT count(*) FROM nation) AS visible UNION ALL SELECT 'good', 'customer', (SELECT count(*) FROM customer), 0, 'loaded', (SELECT count(*) FROM customer)
UNION ALL SELECT 'bad', 'nation', (SELECT count(*) FROM nation), 0, 'refused', NULL UNION ALL SELECT 'bad', 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_acctbal <= 0), 'refused', NULL""")
def bulk_load(spark, d):
    """Two loads of the same tables; one breaks a gate, so none of its tables becomes visible."""
    out = None
    for name, gate in (("good", F.col("c_custkey") >= 0), ("bad", F.col("c_acctbal") > 0)):
        root = files.scratch(spark, f"load-{name}")
        rows = sinks.load_all({t: table(spark, d, t) for t in ("nation", "customer")}, root, {"customer": [gate], "nation": [F.col("n_name").isNotNull()]})
        seen = {t: sinks.loaded(spark, root, t) for t in ("nation", "customer")}
        visible = spark.createDataFrame([(t, None if df is None else df.count()) for t, df in seen.items()], "table string, visible long")
        rows = rows.join(visible, "table").withColumn("load", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH t AS (SELECT 'region' AS "table", 1 AS position, count(*) AS rows, 0 AS lost FROM region UNION ALL SELECT 'nation', 2, count(*), 0 FROM nation UNION ALL SELECT 'customer', 3, count(*), count(*) FILTER (c_nationkey = 7) FROM customer UNION ALL SELECT 'orders', 4, count(*), 0 FROM orders)
SELECT 'good' AS load, "table", position::BIGINT AS position, rows, 0::BIGINT AS orphans, 'loaded' AS status FROM t
UNION ALL SELECT 'broken', "table", position, CASE "table" WHEN 'nation' THEN rows - 1 ELSE rows END, lost, CASE WHEN lost > 0 THEN 'broken reference' ELSE 'held back' END FROM t
UNION ALL SELECT 'changing', "table", position, rows, 0, CASE "table" WHEN 'customer' THEN 'source changed' ELSE 'held back' END FROM t
UNION ALL SELECT 'ring', 'cycle: customer > nation > region > customer', 0, count(*), 0, 'refused' FROM region""")
def ordered_load(spark, d):
    """Four loads of the same tables: sound, with a nation that is missing, with a source that changes on the way, and with a ring of references."""
    names = ("orders", "customer", "nation", "region")
    refs = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    source = {n: (lambda n=n: table(spark, d, n)) for n in names}
    c = table(spark, d, "customer")
    turns = iter((c, c.withColumn("c_acctbal", F.col("c_acctbal") + 1)))
    cases = {"good": {}, "broken": {"nation": lambda: table(spark, d, "nation").where("n_nationkey <> 7")}, "changing": {"customer": lambda: next(turns)}}
    out = None
    for name, other in cases.items():
        rows = loads.load_ordered(source | other, refs, files.scratch(spark, f"ordered-{name}")).withColumn("load", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    try:
        loads.load_ordered(source, [*refs, ("region", "r_regionkey", "customer", "c_custkey")], files.scratch(spark, "ordered-ring"))
    except ValueError as e:
        ring = table(spark, d, "region").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(str(e)).alias("table"), F.lit(0).cast("long").alias("position"), "rows", F.lit(0).cast("long").alias("orphans"), F.lit("refused").alias("status"), F.lit("ring").alias("load"))
        out = out.unionByName(ring)
    return out


@query("SELECT count(*) AS rows, count(DISTINCT c_custkey) AS keys, sum(c_nationkey)::BIGINT AS nations FROM customer")
def snapshot_read(spark, d):
    """A version that stays as it was although another one follows it."""
    root, c = files.scratch(spark, "snapshots"), table(spark, d, "customer")
    first = sinks.snapshot(c, root, "1")
    sinks.snapshot(c.withColumn("c_nationkey", F.lit(0)), root, "2")
    return first.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_custkey").alias("keys"), F.sum("c_nationkey").alias("nations"))


@query("SELECT o_custkey AS subject_id, o_orderkey AS record, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS number FROM orders")
def append_with_ids(spark, d):
    """Records appended to a table whose numbers they continue."""
    path, o = files.scratch(spark, "append"), table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("record"), "o_orderstatus")
    none = o.where("false").select("subject_id", F.lit(0).cast("long").alias("number"))
    old = sinks.append_rows(mutate.allocate_ids(none, o.where("o_orderstatus = 'F'").drop("o_orderstatus"), "subject_id", "number", ["record"]), path)
    return sinks.append_rows(mutate.allocate_ids(old, o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "subject_id", "number", ["record"]), path)


@query("""SELECT 'part ' || k AS name, n AS expected, CASE k WHEN 1 THEN 2 * n WHEN 2 THEN n - m ELSE n END::BIGINT AS rows, CASE k WHEN 1 THEN 'repeated' WHEN 2 THEN 'removed' WHEN 3 THEN 'changed' ELSE 'same' END AS status, k = 0 AS repeat_ignored
FROM (SELECT o_orderkey % 5 AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS m FROM orders GROUP BY k)""")
def append_proof(spark, d):
    """Five appends, of which one is repeated by name; later rows of one are doubled, of one removed, and of one changed."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    log = appendlog.AppendLog(spark, files.scratch(spark, "appends"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema))
    part = lambda k: o.where(F.col("o_orderkey") % 5 == k)
    for k in range(5):
        log.append(part(k), f"part {k}")
    again = log.append(part(0), "part 0")
    folder = {a.name: f"{log.root}/data/folder={a.folder}" for a in log.appends()}
    part(1).write.mode("append").parquet(folder["part 1"])
    part(2).where("o_orderstatus <> 'F'").write.mode("overwrite").parquet(folder["part 2"])
    part(3).withColumn("o_custkey", F.col("o_custkey") + 1).write.mode("overwrite").parquet(folder["part 3"])
    return log.proof().withColumn("repeat_ignored", (F.col("name") == "part 0") & F.lit(not again))


@query("""SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS before, round(c_acctbal * 100)::BIGINT + CASE WHEN c_nationkey < 10 THEN 100 ELSE 0 END AS cents, CASE WHEN c_nationkey < 10 THEN 2 WHEN c_nationkey < 20 THEN 3 ELSE 1 END::BIGINT AS version, c_nationkey BETWEEN 5 AND 12 AS refused
FROM customer WHERE NOT c_nationkey BETWEEN 15 AND 19""")
def concurrent_commit(spark, d):
    """Three writers of one version: one adds, one of other keys adds and deletes, and one overlaps both and is refused."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("long").alias("nation"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    t = commits.CommitTable(spark, files.scratch(spark, "commits"), "c_custkey long, nation long, cents long", "c_custkey")
    t.begin().put(c).commit()
    add, drop, late = t.begin(), t.begin(), t.begin()
    add.put(add.read().where("nation < 10").withColumn("cents", F.col("cents") + 100)).commit()
    drop.put(drop.read().where("nation between 10 and 14")).delete(drop.read().where("nation between 15 and 19").select("c_custkey")).commit()
    wanted = late.read().where("nation between 5 and 12")
    try:
        late.put(wanted.withColumn("cents", F.lit(0).cast("long"))).commit()
        refused = wanted.where("false")
    except commits.Conflict:
        refused = wanted
    rows = t.read().join(late.read().select("c_custkey", F.col("cents").alias("before")), "c_custkey").join(refused.select("c_custkey", F.lit(True).alias("refused")), "c_custkey", "left")
    return rows.select("c_custkey", "before", "cents", F.col("__version").alias("version"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query("""SELECT user_id, string_agg((e - l) || '-' || e, ',' ORDER BY event_id) FILTER (l >= 8000) AS pauses, count(*) FILTER (l >= 8000) AS n FROM (SELECT user_id, event_id, event_id * 20000 + 20000 AS e, 500 + (event_id * 37) % 15000 AS l FROM events) GROUP BY user_id HAVING n > 0""")
def silence_log(spark, d):
    """Long pauses of a detection log for each user."""
    e, l = F.expr("event_id * 20000 + 20000"), F.expr("500 + (event_id * 37) % 15000")
    seconds = lambda ms: F.concat((ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    line = F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), seconds(e), F.lit(" | silence_duration: "), seconds(l))
    lines = table(spark, d, "events").select("user_id", "event_id", line.alias("line"))
    rows = files.pauses(lines, "line", "user_id", "event_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "start_ms", "end_ms"))).alias("p"))
    return rows.select("user_id", F.array_join(F.transform("p", lambda x: F.concat_ws("-", x["start_ms"], x["end_ms"])), ",").alias("pauses"), F.size("p").cast("long").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 9 THEN (s_suppkey * 61317) END AS ms FROM supplier")
def duration_probe(spark, d):
    ms = F.col("s_suppkey") * 61317
    text = F.format_string("  Duration: %02d:%02d:%02d.%03d, start: 0", F.expr("s_suppkey * 61317 div 3600000"), F.expr("s_suppkey * 61317 div 60000 % 60"), F.expr("s_suppkey * 61317 div 1000 % 60"), ms % 1000)
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.expr("s_suppkey % 10 = 9"), "N/A").otherwise(text).alias("t"))
    return rows.select("s_suppkey", T.duration_ms(F.col("t")).alias("ms"))


TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END"


@query(f"SELECT table_name, ordinal_position::BIGINT AS position, column_name, {TYPES} AS type FROM information_schema.columns WHERE table_name IN {TABLES}")
def catalog_columns(spark, d):
    return files.catalog_columns({t: table(spark, d, t) for t in TABLES})


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def catalog_order(spark, d):
    c = table(spark, d, "customer")
    return files.in_catalog_order(c.select("c_mktsegment", "c_acctbal", "c_custkey", "c_nationkey", "c_name"), files.catalog_columns({"customer": c}), "customer")


RAW = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN props || ',' ELSE 'say \"' || event_type || '\"' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not_an_object' ELSE 'invalid_json' END AS fault FROM events")
def strict_json_objects(spark, d):
    return table(spark, d, "events").select("event_id", files.strict_objects(F.expr(RAW)).alias("fault"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN '[' || k || ']' WHEN 2 THEN to_json(props || ',')::VARCHAR ELSE to_json('say "' || event_type || '"')::VARCHAR END AS evidence FROM (SELECT *, '{"k":' || json_extract_string(props, '$.k') || '}' AS k FROM events)""")
def permissive_json(spark, d):
    return table(spark, d, "events").select("event_id", files.permissive_json(F.expr(RAW)).alias("evidence"))


@query("""SELECT c_custkey, CASE WHEN k = 0 THEN 'scheme' WHEN k = 1 THEN 'base64' WHEN k = 2 THEN 'signature' WHEN k = 3 THEN 'too_short' END AS fault, CASE WHEN k > 3 THEN sha256(b) END AS sha256, CASE WHEN k > 3 THEN '{"len":' || octet_length(b) || ',"sha256":"' || sha256(b) || '"}' END AS state
FROM (SELECT c_custkey, c_custkey % 7 AS k, from_hex('89504E470D0A1A0A') || encode(c_name || ' ' || repeat('x', 40)) AS b FROM customer)""")
def data_uri_images(spark, d):
    k = F.expr("c_custkey % 7")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(F.concat("c_name", F.when(k == 3, "").otherwise(F.concat(F.lit(" "), F.repeat(F.lit("x"), 40)))), "UTF-8"))
    body = F.base64(F.when(k == 2, F.encode(F.concat(F.lit("GIF89a"), F.repeat(F.lit("y"), 60)), "UTF-8")).otherwise(png))
    body = F.regexp_replace(body, "\\s", "")
    uri = F.concat(F.when(k == 0, "data:image/gif;base64,").otherwise("data:image/png;base64,"), F.when(k == 1, F.concat(body, F.lit("*"))).otherwise(body))
    data, fault = T.data_uri(F.col("uri"))
    rows = table(spark, d, "customer").select("c_custkey", uri.alias("uri")).select("c_custkey", fault.alias("fault"), data.alias("data"))
    return rows.select("c_custkey", "fault", F.when(F.col("fault").isNull(), F.sha2("data", 256)).alias("sha256"), F.when(F.col("fault").isNull(), T.length_and_digest(F.col("data"))).alias("state"))


@query("SELECT pass_id, result, count(*) AS n FROM (SELECT DISTINCT user_id AS pass_id, event_type AS result FROM events) GROUP BY ALL")
def streamed_results(spark, d):
    """Results that arrive as files of a stream, some of them again; each is kept once."""
    root = files.scratch(spark, "stream")
    rows = table(spark, d, "events").select(F.col("user_id").alias("pass_id"), F.col("event_type").alias("result"))
    rows.write.json(f"{root}/in")
    rows.where("result = 'error'").write.mode("append").json(f"{root}/in")
    stream.append_once(stream.read_results(spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("pass_id", "result").agg(F.count(F.lit(1)).alias("n"))
