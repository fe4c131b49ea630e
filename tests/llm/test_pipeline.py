import corpus_pipeline


def test_stages_keep_clean_documents(spark, tmp_path):
    line = lambda i, j: f"Sentence {j} of story {i} tells how number {i * 31 + j * 7} met number {i * 17 + j * 3} on day {i + j}."
    story = lambda i: "\n".join(line(i, j) for j in range(12))
    passage = " ".join(f"shared{k}" for k in range(60)) + "."
    rows = [(i, story(i), "en", "s", len(story(i))) for i in range(6)]
    rows += [(10, story(1), "en", "s", 1), (11, story(2).replace("day 5", "night 5"), "en", "s", 1), (12, "menu | home | back\n" * 9, "en", "s", 1)]
    rows += [(13, story(13) + "\n" + passage, "en", "s", 1), (14, story(14) + "\n" + passage, "en", "s", 1), (15, story(15) + "\nthe token = abcdef123456 stays here.", "en", "s", 1), (16, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert {*range(6), 13, 14, 15} <= set(seen["quality_rules"]) and not {12, 16} & set(seen["quality_rules"])
    assert set(seen["near_duplicates"]) == {*range(6), 13, 14, 15}
    cut = seen["substring_dedup"]
    assert "shared30" in cut[13].text and "shared30" not in cut[14].text and cut[14].n_chars == len(cut[14].text)
    assert all(cut[i].text == story(i) for i in range(6))
    assert "abcdef123456" not in seen["secret_scan"][15].text and seen["secret_scan"][0].text == story(0)
    assert set(seen["packing"]) == {*range(6), 13, 14, 15}


def test_null_and_shared_ids_stay(spark):
    story = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, story(1)), (None, story(2)), (None, story(3)), (7, story(3)), (5, story(4)), (5, story(5)), (5, story(5)), (8, story(6)), (9, story(6)), (None, story(7)), (None, story(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.text, r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(story(1), None), (story(2), None), (story(3), 7), (story(4), 5), (story(5), 5), (story(6), 8), (story(7), None)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
