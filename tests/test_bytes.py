"""Data sources over files: chunks, limits and records across splits."""

import csv
import hashlib
import io
import random
import tracemalloc

import pytest

from tidemark.sources import bytes as B


def test_hash_needs_no_more_than_chunks(spark, tmp_path):
    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.truncate(300 << 20)
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "empty").write_text("")
    reader = B.FileHashes({"path": f"file://{tmp_path}"}).reader(None)
    parts = reader.partitions()
    assert [[n.rsplit("/", 1)[1] for n, _ in p.names] for p in parts] == [["big.bin"], ["empty"]]
    tracemalloc.start()
    rows = [r for p in parts for r in reader.read(p)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    zeros = hashlib.sha256()
    for _ in range(300):
        zeros.update(bytes(1 << 20))
    assert [(n, h) for _, n, h in rows] == [(300 << 20, zeros.hexdigest()), (0, hashlib.sha256().hexdigest())]
    assert peak < 16 << 20
    got = B.file_hashes(spark, f"file://{tmp_path}", "empty").collect()
    assert [(r.size, r.sha256) for r in got] == [(0, hashlib.sha256().hexdigest())]


def test_limit_before_and_after_the_read(spark, tmp_path):
    for name, n in (("a", 9), ("b", 10), ("c", 11)):
        (tmp_path / name).write_bytes(b"x" * n)
    rows = B.limited_files(spark, f"file://{tmp_path}", 10).orderBy("path").collect()
    assert [(r.size, r.content and len(r.content), r.error) for r in rows] == [(9, 9, None), (10, 10, None), (11, None, "file exceeds 10 bytes")]
    reader = B.LimitedFiles({"path": f"file://{tmp_path}", "limit": "10"}).reader(None)
    parts = reader.partitions()
    (tmp_path / "a").write_bytes(b"x" * 1000)  # grows after it was listed
    first = next(r for p in parts for r in reader.read(p))
    assert first[1:] == (11, None, "file exceeds 10 bytes")
    with pytest.raises(FileNotFoundError):
        B.listed(f"file://{tmp_path}/none", "*")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_split_size_gives_the_same_records(tmp_path, size, end, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 5)
    rng = random.Random(size)
    want, names = [], []
    for name in ("one.csv", "two.csv", "only_header.csv"):
        rows = [] if name == "only_header.csv" else [[str(i), "".join(rng.choice('ab"\n,é ') for _ in range(rng.randrange(1, 12)))] for i in range(30)]
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([["n", "head\n\"er\""], *rows])
        # the last record of one file has no line break
        (tmp_path / name).write_bytes(("﻿" + text.getvalue()).encode().removesuffix(end.encode() if name == "two.csv" else b"none"))
        want += rows
    options = {"path": f"file://{tmp_path}", "partitionbytes": str(size)}
    quotes = B.QuoteParity(options).reader(None)
    states = [odd for p in quotes.partitions() for *_, odd in quotes.read(p)]
    schema = B.StructType.fromDDL("n string, t string")
    reader = B.CsvRecords({**options, "states": " ".join("1" if s else "0" for s in states)}).reader(schema)
    got = [[r["n"], r["t"]] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted(want)


def test_types_nulls_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿n,t,u\n1,"",x\n2,,\n\nno,b\n3,c,d,e\n', encoding="utf-8")
    rows = B.csv_records(spark, f"file://{tmp_path}", "n int, t string, u string", size=4).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == sorted([(1, "", "x"), (2, None, None), (None, "b", None), (3, "c", "d")], key=repr)
    empty = tmp_path / "none"
    empty.mkdir()
    assert B.csv_records(spark, f"file://{empty}", "n int").count() == 0
