import random
from collections import defaultdict

from vocalith.operators import intervals as iv


def brute(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s < e:
            by[k].append((s, e))
    out = set()
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged} | {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, shard):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = [tuple(r) for r in iv.merge_intervals(df, "k", "s", "e", shard).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    for shard in (7, 10, 64, 10_000):
        rows = [(f"k{rng.randrange(6)}", s := rng.randrange(-200, 400), s + rng.choice((0, 1, 2, 3, 9, 40, 120))) for _ in range(260)]
        rows += rows[:40]
        assert run(spark, rows, shard) == brute(rows)


def test_edges_of_shards_runs_and_nulls(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 25, 95), ("a", 41, 43), ("a", 61, 62), ("a", 97, 98), ("b", 5, 5), ("b", None, 9), ("c", 3, None), (None, 1, 2), ("d", -15, -5), ("d", -5, 1), ("d", 4, 6), ("d", 8, 9)]
    assert run(spark, rows, 10) == brute(rows)


def test_hot_key(spark):
    rows = [("hot", 2 * i % 3000, 2 * i % 3000 + 1 + i % 3) for i in range(6000)] + [("x", 0, 5)]
    assert run(spark, rows, 100) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 10) == set()


def test_speech(spark):
    timing = "[{'Word': 'a', 'Offset': 5, 'Duration': 3}, {'Word': \"b's\", 'Offset': 90, 'Duration': 20}]"
    rows = [(" x\t", 0, 50, timing, 1), ("X", 200, 10, "[{broken", 2), ("X", None, 10, None, 3), ("", 0, 9, None, 4), (None, 0, 9, None, 5), ("y", 1, 0, "[]", 6), ("X", 2**62, 2**62, "", 7)]
    df = spark.createDataFrame(rows, "audio_file_id string, offset bigint, duration bigint, word_timing string, extra int")
    got = {tuple(r) for r in iv.speech_periods(df, 100).collect()}
    big = ("X", "period", 2**62, 2**63 - 1)
    assert {g for g in got if g[2] < 2**61 and g[3] < 2**61} == {("X", "period", 0, 50), ("X", "gap", 50, 90), ("X", "period", 90, 110), ("X", "gap", 110, 200), ("X", "period", 200, 210)}
    assert big not in got  # its end can't be told
