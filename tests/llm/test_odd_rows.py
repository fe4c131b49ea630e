"""Every operator on nulls, empty and long texts, repeats, clashing columns and empty tables."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, packing, pieces, quality, recompress, secrets, sharding, toxicity, warc, winnow


def test_quality(odd, none):
    rows = {r.doc_id: r.quality for r in quality.clean_lines(odd).collect()}
    assert rows[1].base_failed and rows[2].n_words == 0 and not rows[2].kept
    assert rows[5].n_words == 30000 and rows[5].n_repeat_words == 30000 and rows[5].base_failed
    assert quality.clean_lines(none).count() == 0


def test_quality_lines(spark):
    clean = "This is a plain sentence that says something useful to a reader.\n"
    text = "\n".join(" ".join(f"w{i * 7 + j}" for j in range(9)) + "." for i in range(9))
    nav = "\n".join([text, "Home | About | Contact | Login", "All rights reserved by nobody in particular here."])
    rows = {r.doc_id: r.quality for r in quality.clean_lines(spark.createDataFrame([(1, text + "\n" + clean), (2, nav), (3, "a | b | c | d\n" * 20)], "doc_id long, text string")).collect()}
    assert rows[1].kept and rows[1].n_removed_lines == 0 and rows[1].clean_text == text + "\n" + clean
    assert rows[2].kept and rows[2].n_removed_lines == 2 and rows[2].clean_text == text
    assert not rows[3].kept and rows[3].n_dup_lines == 19


def test_sharding(odd, none):
    rows = sharding.assign_shards(odd, shards=3).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id in (3, 4)}) == 1
    assert sharding.assign_shards(none, shards=3).count() == 0
    assert len({r.shard for r in sharding.assign_shards(odd, capacity=60000).collect()}) == 2  # one of 150001 bytes has its own


def test_packing(odd, none):
    rows = packing.pack(odd, buckets=3, budget=100).collect()
    assert len(rows) == 10 and all(r.padding >= 0 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[5] == 30000
    assert packing.pack(none).count() == 0


def test_secrets(odd, none):
    rows = {r.doc_id: r.secrets for r in secrets.scan_secrets(odd).collect()}
    assert rows[None].spans == "" and rows[1].base_sha256 == rows[2].base_sha256
    assert secrets.scan_secrets(none).count() == 0


def test_secrets_of_one_case(spark):
    rng = random.Random(13)
    keys = ["".join(rng.choice(letters) for _ in range(n)) for letters in (string.ascii_lowercase, string.ascii_uppercase) for n in (32, 40, 64)] + ["".join(rng.choice(string.ascii_lowercase) for _ in range(40)) + "7"]
    names = ["thankyouverymuchindeedx", "internationalization_of_messages", "SOME_LONG_CONSTANT_NAME_HERE", "12345678901234567890123"]
    rows = {r.doc_id: r.secrets.n_random for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(keys + names)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(rows))] == [1] * len(keys) + [0] * len(names)


def test_recompress(odd, none):
    rows = {r.doc_id: r for r in recompress.repeat_digests(odd).collect()}
    assert all(r.n_removed == 0 for r in rows.values()) and rows[5].n_words == 30000
    assert recompress.repeat_digests(none).count() == 0
    assert recompress.without_repeats(none).count() == 0


def test_near(odd, none):
    rows = {r.doc_id: r.class_id for r in bagminhash.near_duplicate_classes(odd).collect()}
    assert rows == {None: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    assert bagminhash.near_duplicate_classes(none).count() == 0


def test_winnow(odd, none):
    rows = {r.doc_id: r for r in winnow.fingerprints(odd).collect()}
    assert rows[1].fingerprint == "" and rows[3].fingerprint == rows[4].fingerprint != "" and rows[7].fingerprint != ""
    assert winnow.fingerprints(none).count() == 0


def test_pieces(odd, none):
    rows = {r.doc_id: r.pieces for r in pieces.encode(odd).collect()}
    assert rows[1].n_pieces == 0 and all(r.round_trip for r in rows.values())
    back = pieces.decode(pieces.encode(odd).select("doc_id", "text", F.col("pieces.ids").alias("ids")))
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.encode(none).count() == 0


def test_toxicity(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, empty).collect()
    assert len(rows) == 10 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert toxicity.score_toxicity(none, empty).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(1, "u", big), (2, None, big), (2, None, big), (3, "http://a/\r\nb", None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (6, "é", "日本" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("bucket", F.lit(1))
    root = f"file://{tmp_path}/a"
    manifest = warc.write_warc(pages, root, roll_bytes=300, range_bytes=1700)
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(manifest, root).collect()))
    assert got == [(-1, "revisit", 1, 203), (1, "response", None, 203), (2, "revisit", 1, 203), (2, "revisit", 1, 203), (3, "response", None, 0), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 600)]
    again = warc.write_warc(pages.repartition(3), f"file://{tmp_path}/b", roll_bytes=300, range_bytes=1700)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    assert manifest.count() > 2
    none = warc.write_warc(pages.where("false"), f"file://{tmp_path}/c")
    assert warc.read_warc(none, f"file://{tmp_path}/c").count() == 0


def test_warc_ranges_follow_bytes(spark, tmp_path):
    """Null and repeated page_ids are cut by digest; ranges are sorted, and files begin with a warcinfo."""
    pages = spark.range(4000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as page_id", "concat('http://a/', id) as url", "concat('page ', id) as html")
    root = f"file://{tmp_path}/a"
    manifest = warc.write_warc(pages, root, range_bytes=1, least_ranges=8, max_ranges=40)
    rows = warc.read_warc(manifest, root)
    assert sorted((r.page_id is None, r.page_id or 0, r.url) for r in rows.collect()) == sorted((r.page_id is None, r.page_id or 0, r.url) for r in pages.collect())
    per = {r.bucket: r.records for r in manifest.collect()}
    assert len(per) > 30 and max(per.values()) < 3 * 4000 / 40
    by = {}
    for r in rows.select("page_id", "file").collect():
        by.setdefault(int(r.file.split("-")[1]), []).append(-1 if r.page_id is None else r.page_id)
    buckets = sorted(by)
    assert all(max(by[a]) <= min(by[b]) for a, b in zip(buckets, buckets[1:]))
    name = manifest.first().file
    with open(f"{tmp_path}/a/data/{name}", "rb") as stream:
        first = next(warc.members(stream))
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and name.encode() in first


def test_range_edges_of_millions_of_keys(spark):
    from tidemark.llm._common import bucket_of, range_edges

    keys = spark.range(2_500_000).selectExpr("case when id % 10 < 3 then id % 7 else id * id end as k")
    ranges = range_edges(keys, "k", 500)
    assert len(ranges) > 3000 and ranges == range_edges(keys.repartition(3), "k", 500)
    held = keys.groupBy(bucket_of(F.col("k"), [r.upper for r in ranges]).alias("b")).count().collect()
    assert sum(r["count"] for r in held) == 2_500_000
    parts = [r.parts for r in ranges]
    assert max(r["count"] / parts[r.b] for r in held) <= 1000
    far = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (None,)], "k long")
    assert [r.top for r in range_edges(far, "k", 1)] == [-(2**63), 0, 2**63 - 1]
    assert range_edges(far.where("k is null"), "k", 1) == []


def test_random_keys_of_short_groups():
    """Licence keys and recovery codes are found; words, dates and numbered names in short groups are not."""
    rng = random.Random(3)
    spans = lambda t: secrets.random_spans(t, [], secrets.VOCABULARY, 2.0) + secrets.url_spans(t, [], secrets.VOCABULARY, 2.0)
    for size, n in ((3, 8), (3, 7), (2, 10), (4, 6)):
        keys = ["-".join("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size)) for _ in range(n)) for _ in range(300)]
        assert sum(bool(spans(f"the key is {k} now")) for k in keys) >= 285
    for name in ("rock-and-roll-is-not-dead", "2024-05-06-12-30-45-678", "to-be-or-not-to-be-that-is", "one_two_three_four_five"):
        assert not spans(f"see {name} there")


def test_url_spans_by_definition():
    """Userinfo, path and query of URLs: every run or segment whose own ratio is low, and nothing else."""
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    for _ in range(60):
        parts = {"user": key(24), "path": key(22), "query": key(26)}
        used = {k: rng.random() < 0.5 for k in parts}
        pick = lambda k, plain: parts[k] if used[k] else plain  # noqa: E731,B023
        text = f"go to https://{pick('user', 'someone')}@documentation.example.org/{pick('path', 'introduction-to-the-guide')}/x?q={pick('query', 'internationalization')} or not"
        found = {text[a:b] for a, _, b in secrets.url_spans(text, [], secrets.VOCABULARY, 2.0)}
        covered = lambda k: any(parts[k] in f for f in found)  # noqa: E731,B023
        assert all(covered(k) == used[k] for k in parts), (text, found)


def test_quality_of_long_lines(spark):
    """Boilerplate in long lines counts by its density, and the end of a line by its last mark, however many brackets follow."""
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{prose} privacy policy {prose}."), (2, " ".join(["See our privacy policy and terms of use before you go on here"] * 12) + "."), (3, f"{prose}:" + ")" * 30), (4, f"{prose} end" + ")" * 30)]
    got = {r.doc_id: r.quality for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed_lines for i in (1, 2, 3, 4)] == [0, 1, 0, 1]


def test_quality_column_of_another_case(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, Quality string")
    assert quality.kept_documents(df).count() == 0 and quality.clean_lines(df).columns == ["doc_id", "text", "quality"]


def test_spelled_insult_is_whole_in_a_part_at_every_offset():
    insult = "i-d-i-o-t-s-s"
    assert len(insult) == 2 * toxicity.SPAN - 1
    for n in (25, 60, 200):
        for at in range(n):
            word = "x" * at + insult + "y" * (n - at)
            parts = toxicity.pieces(word)
            assert any(insult.encode() in p for p in parts), (n, at)
            assert all(len(p) <= toxicity.LONGEST for p in parts) and parts[-1].endswith(b"y")


def test_recompress_with_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, "a", 5, 6, 7, 8), (2, "before " + passage + " after", "b", 5, 6, 7, 8), (3, passage, "c", 5, 6, 7, 8), (None, passage, "d", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, tag int, kept int, __id int, row int")
    got = {r.gone: r for r in recompress.without_repeats(docs).collect()}
    assert got.keys() == {"a", "b", "d"} and got["b"].text == "before after" and got["a"].text == got["d"].text == passage
    assert recompress.without_repeats(docs).columns == docs.columns
    assert (got["b"].tag, got["b"].kept, got["b"]["__id"], got["b"].row) == (5, 6, 7, 8)
