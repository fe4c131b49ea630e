"""Queries of parity and structure checks, of predicates and orders, and of small scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import sqltext
from tidemark.functions import text as T
from tidemark.operators import expect, intervals, mutate, report
from tidemark.plans import exam
from tidemark.plans.audit_catalog import FINDINGS, LEVEL
from tidemark.plans.registry import query, table
from tidemark.sinks import files as sinks
from tidemark.sources.files import scratch

# --- parity and structure ----------------------------------------------------------------


@query("""SELECT subject_id // 60 AS exam_id, count(*) AS n_rows, sha256(string_agg(r, chr(10) ORDER BY r)) AS digest FROM (SELECT c_custkey AS subject_id, '{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_name":' || to_json(c_name) || ',"note":' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE '{"len":' || octet_length(encode(c_mktsegment)) || ',"sha256":"' || sha256(c_mktsegment) || '"}' END || '}' AS r FROM customer) GROUP BY 1""")
def exact_group_digests(spark, d):
    """Digests of canonical rows, a group at a time; binaries count by length and hash."""
    c = table(spark, d, "customer")
    c = c.select(F.expr("c_custkey div 60").alias("exam_id"), "c_custkey", "c_name", "c_acctbal", F.when(F.col("c_nationkey") != 3, F.encode("c_mktsegment", "UTF-8")).alias("note"))
    rows = expect.exact_digests(c, "exam_id", ["c_custkey", "c_name", "c_acctbal", "note"])
    return rows


@query("SELECT n_nationkey, n_name, surplus FROM (SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 1 WHEN n_regionkey = 2 THEN -1 ELSE 0 END::BIGINT AS surplus FROM nation) WHERE surplus <> 0")
def multiset_diff(spark, d):
    n = table(spark, d, "nation")
    right = n.where("n_regionkey <> 1").unionByName(n.where("n_regionkey = 2"))
    return expect.multiset_diff(n, right, ["n_nationkey", "n_name"])


@query("""SELECT * FROM (VALUES ('region', true, (SELECT count(*) FROM region), (SELECT count(*) FROM region), true), ('nation', false, (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), true), ('supplier', true, (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), false), ('part', true, (SELECT count(*) FROM part), (SELECT count(*) FROM part) + 1, false), ('audits', false, NULL, NULL, false)) AS t("table", same_columns, left_rows, right_rows, same_rows)""")
def deep_parity(spark, d):
    """Tables of two stores: equal, with other columns, with other rows, with a repeated row, and missing."""
    r, n, s, p = (table(spark, d, t) for t in ("region", "nation", "supplier", "part"))
    first = p.orderBy("p_partkey").limit(1)
    pairs = {"region": (r, r), "nation": (n, n.withColumn("note", F.lit(1))), "supplier": (s, s.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 3, 0.5).otherwise(F.col("s_acctbal")))), "part": (p, p.unionByName(first)), "audits": (r, None)}
    return expect.table_parity(pairs)


@query("""SELECT 'customer' AS "table", (SELECT count(*) FROM customer) AS n_rows, 0::BIGINT AS orphans UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))""")
def source_inspection(spark, d):
    """Counts of each table and rows that refer to nothing; the targets are narrowed so that some do."""
    c, o, l = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    orphans = {"customer": c.where("false"), "orders": expect.fk_violations(o, "o_custkey", c.where("c_acctbal > 0"), "c_custkey"), "lineitem": expect.fk_violations(l, "l_orderkey", o.where("o_orderstatus <> 'P'"), "o_orderkey")}
    rows = []
    for name, df in (("customer", c), ("orders", o), ("lineitem", l)):
        both = df.select(F.lit(name).alias("table"), F.lit(0).alias("o")).unionAll(orphans[name].select(F.lit(name), F.lit(1)))
        rows.append(both.groupBy("table").agg(F.count_if(F.col("o") == 0).alias("n_rows"), F.count_if(F.col("o") == 1).alias("orphans")))
    return reduce(DataFrame.unionByName, rows)


@query("""SELECT * FROM (VALUES ('nation', 'column', 'n_regionkey', '3 int null', '3 bigint null'), ('nation', 'column', 'n_name', '2 string null ''x''', '2 string null'), ('nation', 'reference', 'n_regionkey', 'region(r_regionkey)', NULL), ('region', 'key', 'r_name', 'unique', NULL), ('region', 'checks', 'count', '1', '2'), ('region', 'column', 'note', NULL, '3 string null')) AS t("table", kind, name, expected, actual)""")
def structure_diff(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    expected = expect.structure({"region": r, "nation": n}, {"region": [["r_regionkey"], ["r_name"]], "nation": [["n_nationkey"]]}, [("nation", "n_regionkey", "region", "r_regionkey")], {"region": ["r_regionkey >= 0"]}, {("nation", "n_name"): "'x'"})
    actual = expect.structure({"region": r.withColumn("note", F.lit(None).cast("string")), "nation": n.withColumn("n_regionkey", F.col("n_regionkey").cast("long"))}, {"region": [["r_regionkey"]], "nation": [["n_nationkey"]]}, [], {"region": ["r_regionkey >= 0", "r_name <> ''"]})
    return expect.structure_diff(expected, actual)


@query("SELECT o_orderkey, o_orderstatus, 1::BIGINT AS surplus FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def append_only_check(spark, d):
    """Rows of a log that were changed or removed, among others that were added."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("not (o_orderpriority = '1-URGENT' and o_orderstatus = 'F')").withColumn("o_orderstatus", F.when(F.expr("o_orderpriority = '5-LOW' and o_orderstatus = 'O'"), "X").otherwise(F.col("o_orderstatus")))
    new = new.unionByName(o.withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return expect.append_only_violations(o, new, ["o_orderkey", "o_orderstatus"])


@query("""SELECT check_name, expected, actual, expected = actual AS ok FROM (SELECT 'exams' AS check_name, '25' AS expected, count(DISTINCT n_nationkey)::VARCHAR AS actual FROM nation UNION ALL SELECT 'regions', '5', count(DISTINCT n_regionkey)::VARCHAR FROM nation UNION ALL SELECT 'missing', '1', count(*) FILTER (n_name IS NULL)::VARCHAR FROM nation)""")
def approved_baseline(spark, d):
    checks = {"exams": (F.count_distinct("n_nationkey"), 25), "regions": (F.count_distinct("n_regionkey"), 5), "missing": (F.count_if(F.col("n_name").isNull()), 1)}
    return expect.baseline(table(spark, d, "nation"), checks)


@query("SELECT page_id, octet_length(encode(html))::BIGINT AS size, CASE WHEN page_id % 9 = 4 THEN 'content' ELSE 'size' END AS drift FROM pages WHERE page_id % 9 IN (4, 5)")
def blob_drift(spark, d):
    """Blobs whose size or hash is not the recorded one; some records are wrong."""
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("b"))
    listed = p.select("page_id", F.octet_length("b").alias("size"), F.when(F.expr("page_id % 9 = 4"), "0").otherwise(F.sha2("b", 256)).alias("sha")).withColumn("recorded", F.col("size") + F.when(F.expr("page_id % 9 = 5"), 1).otherwise(0))
    rows = p.join(listed, "page_id").withColumn("drift", F.when(F.octet_length("b") != F.col("recorded"), "size").when(F.sha2("b", 256) != F.col("sha"), "content"))
    return rows.where("drift is not null").select("page_id", F.col("size").cast("long").alias("size"), "drift")


@query("SELECT region, CASE WHEN region % 2 = 0 THEN 'name,size' ELSE 'size' END AS fields FROM (SELECT r_regionkey AS region FROM region)")
def report_compare(spark, d):
    r = table(spark, d, "region")
    rows = r.select(F.col("r_regionkey").alias("region"), F.struct(F.col("r_name").alias("name"), F.lit(1).alias("size"), F.lit(None).cast("string").alias("note")).alias("a"), F.struct(F.when(F.expr("r_regionkey % 2 = 0"), "other").otherwise(F.col("r_name")).alias("name"), F.lit(2).alias("size"), F.lit(None).cast("string").alias("note")).alias("b"))
    return rows.select("region", F.array_join(T.differing_fields("a", "b", ("name", "note", "size")), ",").alias("fields"))


# --- mutations -----------------------------------------------------------------------------


@query("SELECT key, value FROM (SELECT 'rule_' || n_regionkey AS key, max(CASE WHEN n_regionkey % 2 = 0 THEN 'v2' ELSE 'v1' END) AS value FROM nation GROUP BY 1) UNION ALL SELECT 'schema_version', '2'")
def kv_replace(spark, d):
    keys = table(spark, d, "nation").select(F.concat(F.lit("rule_"), "n_regionkey").alias("key"), "n_regionkey").distinct()
    old = keys.select("key", F.lit("v1").alias("value"))
    new = keys.where("n_regionkey % 2 = 0").select("key", F.lit("v2").alias("value")).unionByName(spark.createDataFrame([("schema_version", "2")], "key string, value string"))
    return mutate.replace_values(old, new, "key")


@query("SELECT user_id, min(event_type) AS first_content, count(*) FILTER (event_type = m) - 1 AS already, count(*) FILTER (event_type <> m) AS conflicts FROM (SELECT *, min(event_type) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def insert_ignore_repeats(spark, d):
    """New rows that share their key: one is inserted, its copies are known, others conflict."""
    e = table(spark, d, "events").select("user_id", "event_type")
    rows = mutate.insert_ignore(e.where("false"), e, "user_id", "event_type")
    return rows.groupBy("user_id").agg(F.min(F.when(F.col("status") == "inserted", F.col("event_type"))).alias("first_content"), F.count_if(F.col("status") == "already_imported").alias("already"), F.count_if(F.col("status") == "conflict").alias("conflicts"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE '{' || concat_ws(',', CASE WHEN c_nationkey % 2 = 0 THEN '"name":{"before":' || to_json(c_name) || ',"after":' || to_json(c_name || '!') || '}' END, CASE WHEN c_nationkey <> 3 THEN '"segment":{"before":' || to_json(c_mktsegment) || ',"after":null}' END) || '}' END AS changes FROM customer""")
def change_map(spark, d):
    """Fields before and after; null where nothing changed."""
    new_name = F.when(F.expr("c_nationkey % 2 = 0"), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    new_segment = F.when(F.col("c_nationkey") == 3, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.before_after({"name": (F.col("c_name"), new_name), "segment": (F.col("c_mktsegment"), new_segment)}).alias("changes"))


# --- predicates, joins and orders ------------------------------------------------------------


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value that is given; None asks for nothing."""
    given = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, given)) if given else df


@query("SELECT (SELECT count(*) FROM orders) AS everything, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS one, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') AS two")
def dynamic_where(spark, d):
    o = table(spark, d, "orders")
    tagged = [where_all(o, o_orderstatus=s, o_orderpriority=p).select(F.lit(n).alias("n")) for n, s, p in (("everything", None, None), ("one", "F", None), ("two", "F", "2-HIGH"))]
    return reduce(DataFrame.unionAll, tagged).agg(*[F.count_if(F.col("n") == n).alias(n) for n in ("everything", "one", "two")])


@query("SELECT p_partkey, p_name, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS wanted, p_size NOT IN (2, 3, 4) AS other_size, p_name LIKE 'small%' AS small, p_name NOT LIKE '%widget' AS no_widget, list_contains(['ECONOMY', 'PROMO'], p_type) AS cheap FROM part")
def predicates(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_name", F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3").alias("wanted"), (~F.col("p_size").isin(2, 3, 4)).alias("other_size"), F.col("p_name").like("small%").alias("small"), (~F.col("p_name").like("%widget")).alias("no_widget"), F.array_contains(F.array(F.lit("ECONOMY"), F.lit("PROMO")), F.col("p_type")).alias("cheap"))


@query("SELECT q.*, choice_number, agree, answer_page, instruction FROM q JOIN an USING (subject_id) LEFT JOIN gr ON gr.exam_id = q.exam_id AND g = (number - 1) // 10", exam.SQL)
def question_star_join(spark, d):
    """All columns of a question and those that are joined to it."""
    q = exam.questions(spark, d)
    g = exam.groups(q).select("exam_id", "g", "instruction")
    return q.join(exam.answers(q), "subject_id").withColumn("g", F.expr("(number - 1) div 10")).join(g, ["exam_id", "g"], "left").drop("g")


@query("SELECT exam_id, count(*) FILTER (segment_status = 'verified' AND clip IS NOT NULL) AS exported, count(*) FILTER (NOT (segment_status = 'verified' AND clip IS NOT NULL)) AS others, string_agg(number::VARCHAR, ',' ORDER BY number) AS numbers FROM seg GROUP BY exam_id", exam.SQL)
def exported_segments(spark, d):
    s = exam.segments(exam.questions(spark, d))
    ready = (F.col("segment_status") == "verified") & F.col("clip").isNotNull()
    return s.groupBy("exam_id").agg(F.count_if(ready).alias("exported"), F.count_if(~ready).alias("others"), F.array_join(F.array_sort(F.collect_list("number")).cast("array<string>"), ",").alias("numbers"))


@query("SELECT exam_id, count(*) AS subjects, string_agg(subject_id::VARCHAR, ',' ORDER BY number) AS ids FROM q WHERE section = 'listening' GROUP BY exam_id", exam.SQL)
def perspective_subjects(spark, d):
    """What a pass of the alignment perspective gets to see."""
    q = exam.questions(spark, d).withColumn("perspective", F.lit(exam.ALIGNMENT))
    seen = q.where((F.col("perspective") != exam.ALIGNMENT) | (F.col("section") == "listening"))
    rows = seen.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("number", "subject_id"))).alias("s"))
    return rows.select("exam_id", F.size("s").cast("long").alias("subjects"), F.array_join(F.transform("s", lambda x: x["subject_id"].cast("string")), ",").alias("ids"))


@query(f"SELECT run_id, string_agg(fingerprint || ':' || risk_score, ',' ORDER BY risk_score DESC, fingerprint) AS ranked, max(risk_score) AS top, {LEVEL.format('max(risk_score)')} AS level FROM cf GROUP BY run_id", FINDINGS)
def findings_ranked(spark, d):
    """Findings of a run, the gravest first, equal ones by fingerprint."""
    a = exam.audits(spark, d)
    rows = report.consensus_findings(a).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("r"), "fingerprint"))).alias("f"), F.max("risk_score").alias("top"))
    from tidemark.operators.audit import risk_level

    return rows.select("run_id", F.array_join(F.transform("f", lambda x: F.concat(x["fingerprint"], F.lit(":"), (-x["r"]).cast("string"))), ",").alias("ranked"), "top", risk_level(F.col("top")).alias("level"))


# --- scalars -------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'exam-' || lpad(c_nationkey::VARCHAR, 3, '0') AS padded, c_nationkey % 3 = 0 AS is_digest, c_nationkey % 4 = 1 AS is_id, c_nationkey % 5 IN (0, 1) AS safe, CASE WHEN c_nationkey % 5 = 1 THEN c_name || '.pdf' ELSE ['a/', '', '../', '/', 'C:/'][c_nationkey % 5 + 1] || CASE WHEN c_nationkey % 5 = 1 THEN '' ELSE c_name || '.pdf' END END AS logical,
CASE WHEN c_nationkey % 2 = 0 THEN '''' || c_mktsegment || '''' ELSE c_custkey::VARCHAR END AS plain_default FROM customer""")
def scalar_checks(spark, d):
    """Padded ids, digest and id patterns, safe paths, logical roots and plain defaults."""
    n = F.col("c_nationkey")
    digest = F.when(n % 3 == 0, F.upper(F.sha2("c_name", 256))).when(n % 3 == 1, F.concat(F.sha2("c_name", 256), F.lit("0"))).otherwise("g" * 64)
    ident = F.when(n % 4 == 1, "exam-I-L-007").when(n % 4 == 2, "exam-I-L-07").otherwise("exam-I-X-007")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a/", "media/", "../", "/", "C:/")]), (n % 5 + 1).cast("int")), "c_name", F.lit(".pdf"))
    default = F.when(n % 2 == 0, F.concat(F.lit("'"), "c_mktsegment", F.lit("'::character varying(20)"))).otherwise(F.concat(F.lit(" ("), F.col("c_custkey"), F.lit(")::bigint")))
    return table(spark, d, "customer").select("c_custkey", T.padded_id(F.lit("exam"), n).alias("padded"), T.is_hex_digest(digest).alias("is_digest"), T.matches_id(ident, "exam-I").alias("is_id"), T.safe_path(path).alias("safe"), T.without_root(path, "media").alias("logical"), T.plain_default(default).alias("plain_default"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS micros, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact FROM events")
def time_texts(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seconds"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("micros"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("compact"))


@query("SELECT l_orderkey, map_values(m)[1] AS first_part, len(map_keys(m)) AS numbers, list_sort(map_keys(m)) = range(1, len(map_keys(m))::INT + 1)::INT[] AS covered FROM (SELECT l_orderkey, map_from_entries(list((l_linenumber, p) ORDER BY l_linenumber)) AS m FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)")
def rows_to_map(spark, d):
    """Lines as a map from number to part, and whether the numbers run from 1 without gaps."""
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    m = one.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "p")))).alias("m"))
    keys = F.array_sort(F.map_keys("m"))
    return m.select("l_orderkey", F.get(F.map_values("m"), F.lit(0)).alias("first_part"), F.size("m").cast("long").alias("numbers"), (keys == F.sequence(F.lit(1), F.size(keys))).alias("covered"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'mp3' END AS kind, s_suppkey % 8 = 1 AS whole FROM supplier")
def magic_bytes(spark, d):
    k = F.expr("s_suppkey % 4")
    body = F.encode(F.concat("s_name", F.when(F.expr("s_suppkey % 8 = 1"), F.concat(F.repeat(F.lit("z"), 3000), F.lit("%%EOF"))).otherwise(F.concat(F.lit("%%EOF"), F.repeat(F.lit("z"), 3000)))), "UTF-8")
    data = F.concat(F.unhex(F.when(k == 0, "89504E470D0A1A0A").when(k == 1, "255044462D").when(k == 2, "FFFB").otherwise("00")), body)
    rows = table(spark, d, "supplier").select("s_suppkey", data.alias("b"))
    return rows.select("s_suppkey", T.magic(F.col("b")).alias("kind"), F.coalesce(T.whole_pdf(F.col("b")), F.lit(False)).alias("whole"))


@query("SELECT o_orderstatus, count(*) AS n, 'what?' AS question FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '5-LOW' GROUP BY o_orderstatus")
def bound_sql(spark, d):
    """SQL with positional marks; one inside a string is none."""
    text = "SELECT o_orderstatus, count(*) AS n, 'what?' AS question /* really? */ FROM {o} WHERE o_totalprice > ? AND o_orderpriority <> ? GROUP BY o_orderstatus -- done?"
    return sqltext.run(spark, text, 100000, "5-LOW", o=table(spark, d, "orders"))


@query("SELECT s_suppkey, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 3 AS stable, (31 - CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS pauses FROM supplier")
def threshold_gate(spark, d):
    """Pauses at four thresholds: 31 each and near the primary ones, or not."""
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(t) for t in ("-30", "-35", "-40", "-50")])).alias("threshold"))
    p = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(31)))).where("s_suppkey % 5 <> 0 or i <= 30")
    late = F.when(F.expr("s_suppkey % 7 = 3 and threshold = '-50' and i = 9"), 121).otherwise(F.expr("cast(threshold as int) + 35"))
    p = p.select("s_suppkey", "threshold", (F.col("i") * 30000 + late).cast("long").alias("start_ms"), (F.col("i") * 30000 + 9000).cast("long").alias("end_ms"))
    return intervals.threshold_stability(p, "s_suppkey", "-35")


@query("SELECT n_regionkey AS region, CASE WHEN n_regionkey = 2 THEN count(*) ELSE 0 END AS missing, CASE WHEN n_regionkey = 3 THEN 1 ELSE 0 END::BIGINT AS unexpected, n_regionkey NOT IN (2, 3) AS same FROM nation GROUP BY n_regionkey")
def recorded_sets(spark, d):
    """Recorded against expected pairs of name and hash for each region."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha"))
    extra = n.where("region = 3").groupBy("region").agg(F.lit("more").alias("path"), F.lit("x").alias("sha"))
    return expect.same_sets(n, n.where("region <> 2").unionByName(n.where("region = 1")).unionByName(extra), "region", ["path", "sha"])


@query("SELECT l_orderkey, i::BIGINT AS i, parts[i] AS part, flags[i] AS flag FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey)[1:2] AS flags FROM lineitem GROUP BY l_orderkey), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)")
def parallel_unnest(spark, d):
    """Two arrays unnested side by side; the shorter one is filled with nulls."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("a"))
    both = F.arrays_zip(F.transform("a", lambda x: x["l_partkey"]).alias("part"), F.slice(F.transform("a", lambda x: x["l_returnflag"]), 1, 2).alias("flag"))
    return rows.select("l_orderkey", F.posexplode(both).alias("i", "x")).select("l_orderkey", (F.col("i") + 1).cast("long").alias("i"), F.col("x.part").alias("part"), F.col("x.flag").alias("flag"))


@query(r"SELECT page_id, sha256(substr(html, 21, 30)) AS rows FROM (SELECT page_id, regexp_replace(html, '[^\x20-\x7E]', '', 'g') AS html FROM pages)")
def pixel_rows(spark, d):
    """Three rows of ten bytes, from the third on."""
    plain = F.regexp_replace("html", r"[^\x20-\x7E]", "")
    return table(spark, d, "pages").select("page_id", F.sha2(T.pixel_rows(F.encode(plain, "UTF-8"), 10, 2, 3), 256).alias("rows"))


@query("SELECT 2 AS run, count(*) AS n FROM orders")
def summary_replaced(spark, d):
    """A summary that was written twice; readers get the newest."""
    root, o = scratch(spark, "summaries"), table(spark, d, "orders")
    for run in (1, 2):
        sinks.replace_summary(o.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n")), root, run)
    return sinks.newest_summary(spark, root, "run int, n long")
