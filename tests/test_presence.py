"""Bitmaps of presence against plain sets."""

import random

from pyspark.sql import functions as F

from tidemark.operators import presence as P


def test_bitmaps_equal_sets(spark):
    rng = random.Random(5)
    sets = {f"k{i}": set(rng.choices(range(1, 260), k=rng.choice([1, 2, 5, 60]))) for i in range(40)} | {"edges": {1, 63, 64, 126, 127, 189}, None: {63}}
    rows = spark.createDataFrame([(k, n) for k, s in sets.items() for n in s for _ in range(2)], "k string, n int")
    dense = [list(map(int, x)) for x in ((0, (1 << 63) - 1), (1, 5), (2, 1 << 62), (3, 0), (4, 1))]
    inside = set(range(1, 64)) | {64, 66} | {189} | {253}
    b = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(v).cast("long").alias("bits")) for w, v in dense])
    m = P.bitmaps(rows, ["k"], "n")
    got = m.select("k", P.lowest(F.col("bits")).alias("low"), P.count(F.col("bits")).alias("n"), P.numbers(F.col("bits")).alias("all"), P.numbers(P.both(F.col("bits"), b)).alias("both"), P.has(F.col("bits"), F.lit(63)).alias("has"), P.numbers(P.without(F.col("bits"), F.lit(63))).alias("less"))
    found = {r.k: r for r in got.collect()}
    assert found.keys() == sets.keys()
    for k, s in sets.items():
        r = found[k]
        assert (r.low, r.n, r.all) == (min(s), len(s), sorted(s))
        assert r.both == sorted(s & inside) and r.has == (63 in s) and r.less == sorted(s - {63})


def test_states_of_many_runs(spark):
    """Over 63 runs, against the plain definition, with a finding whose fingerprint is null."""
    rng = random.Random(9)
    runs = []
    for subject in ("a", "b", "c"):
        for rank in range(1, 151):
            prints = [f for f in ("x", "y", "z", None) if rng.random() < {"x": 0.5, "y": 0.02, "z": 0.01, None: 0.1}[f]]
            if subject == "c" and rank == 1:
                prints = ["y", None]
            runs.append((subject, f"run{200 - rank}", rank, rng.random() < 0.7 or rank == 1 and subject != "b", [(f, rng.randint(1, 3)) for f in prints]))
    df = spark.createDataFrame(runs, "subject_id string, run_id string, rank int, complete boolean, findings array<struct<fingerprint:string,n:int>>").repartition(7)
    got = {(r.subject_id, r.fingerprint): r for r in P.found_states(df).collect()}
    keys = {(s, f) for s, _, _, _, found in runs for f, _ in found}
    assert got.keys() == keys
    for s, f in keys:
        own = sorted((rank, run, complete, dict(found)) for t, run, rank, complete, found in runs if t == s)
        seen = [(run, d[f]) for _, run, _, d in own if f in d]
        done = [(run, f in d) for _, run, c, d in own if c]
        r = got[s, f]
        assert (r.seen_run_count, r.occurrence_count, r.first_seen_run_id, r.latest_seen_run_id) == (len(seen), sum(n for _, n in seen), seen[-1][0], seen[0][0])
        assert r.occurrences_by_run == ",".join(f"{run}:{n}" for run, n in seen)
        gap = []
        if not own[0][2]:
            state = "latest_run_incomplete"
        elif not done[0][1]:
            state = "not_reproduced_in_latest_run"
        else:
            before = next((i for i, (_, p) in enumerate(done) if i and p), None)
            gap = [run for run, _ in done[1:before]] if before else []
            state = "reappeared_in_latest_run" if gap else "present_in_latest_run"
        assert (r.latest_state, r.intervening_runs) == (state, ",".join(gap))
