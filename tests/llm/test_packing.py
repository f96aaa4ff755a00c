import random
from collections import defaultdict

import pytest

from vocalith.llm import packing

TYPE = "doc_id bigint, n_tokens bigint, size string"


def capacities(spark, *sizes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "capacity_id int, capacity_tokens int")


def check(packed, sizes, caps):
    """Every text whole in one bin unless it is larger than one; no bin over its capacity; every token once."""
    bins, parts = defaultdict(int), defaultdict(list)
    for r in packed:
        if r.n_tokens:
            bins[r.capacity_id, r.bin_id] += r.n_tokens
            assert r.bin_id is not None
        else:
            assert r.bin_id is None
        parts[r.capacity_id, r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
    for (c, _), used in bins.items():
        assert used <= caps[c]
    for c, cap in enumerate(caps):
        for d, n in sizes.items():
            p = sorted(parts[c, d])
            assert sum(x[2] for x in p) == n
            assert len(p) == max(1, -(-n // cap))
            assert [x[1] for x in p] == [i * cap for i in range(len(p))]
    return bins


def test_random(spark):
    rng = random.Random(1)
    sizes = {i: int(rng.lognormvariate(3.5, 1.2)) for i in range(1500)} | {9000: 0, 9001: 64, 9002: 65, 9003: 6400, 9004: 1}
    caps = (64, 512)
    df = spark.createDataFrame([(d, n, "clash") for d, n in sizes.items()], TYPE)
    packed = packing.pack(df, capacities(spark, *caps)).collect()
    bins = check(packed, sizes, caps)
    for c, cap in enumerate(caps):
        count = sum(1 for k in bins if k[0] == c)
        assert count <= 1.03 * sum(sizes.values()) / cap + 2


def test_hot_size(spark):
    sizes = {i: 33 for i in range(3000)} | {5000 + i: 31 for i in range(500)}
    df = spark.createDataFrame([(d, n, "") for d, n in sizes.items()], TYPE)
    bins = check(packing.pack(df, capacities(spark, 64), salts=4).collect(), sizes, (64,))
    assert len(bins) == 3000


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], TYPE)
    assert packing.pack(none, capacities(spark, 64)).count() == 0
    zero = spark.createDataFrame([(1, 0, "")], TYPE)
    assert [r.bin_id for r in packing.pack(zero, capacities(spark, 64)).collect()] == [None]


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    rng = random.Random(seed)
    cap = rng.choice((5, 16, 100))
    histogram = {s: rng.randrange(0, 40) for s in rng.sample(range(1, cap + 1), min(cap, rng.randrange(1, 12)))}
    used, ranks = defaultdict(int), defaultdict(int)
    for size, first, n, per, at in packing.plan_bins(histogram, cap):
        assert ranks[size] == first
        ranks[size] += n
        for j in range(n):
            used[at + j // per] += size
    assert {s: n for s, n in histogram.items() if n} == {s: n for s, n in ranks.items() if n}
    assert all(v <= cap for v in used.values())
    assert sorted(used) == list(range(len(used)))


def test_report(spark):
    df = spark.createDataFrame([(1, 60, ""), (2, 4, ""), (3, 64, "")], TYPE)
    r = packing.packing_report(packing.pack(df, capacities(spark, 64)), capacities(spark, 64)).first()
    assert (r.n_bins, r.n_pieces, r.filled) == (2, 3, 1.0)


def test_harmonic(spark):
    """Texts whole, bins within capacity, and k texts of class k in all bins but one a class and salt."""
    rng = random.Random(5)
    sizes = {i: int(rng.lognormvariate(3.5, 1.2)) for i in range(1500)} | {9000: 0, 9001: 64, 9002: 65, 9003: 6400, 9004: 1}
    caps = (64, 512)
    df = spark.createDataFrame([(d, n, "clash") for d, n in sizes.items()], TYPE)
    packed = packing.harmonic(df, capacities(spark, *caps), salts=3).collect()
    check(packed, sizes, caps)
    held = defaultdict(list)
    for r in packed:
        if r.n_tokens:
            held[r.capacity_id, r.bin_id].append(caps[r.capacity_id] // r.n_tokens)
    few = defaultdict(int)
    for (c, _), ks in held.items():
        assert len(set(ks)) == 1
        few[c, ks[0]] += len(ks) < ks[0]
    assert max(few.values()) <= 3
    for c in range(2):
        numbers = {b for x, b in held if x == c}
        assert numbers == set(range(len(numbers)))


def test_checks_see_faults(spark):
    df = spark.createDataFrame([(1, 60, ""), (2, 4, ""), (3, 64, ""), (4, 0, "")], TYPE)
    good = packing.pack(df, capacities(spark, 64))
    assert packing.packing_checks(good, df, capacities(spark, 64)).first().asDict() == {"capacity_id": 0, "n_texts": 4, "n_empty": 1, "n_lost": 0, "n_cut": 0, "n_over": 0}
    bad = good.withColumn("bin_id", good.bin_id * 0).where("doc_id <> 2")
    r = packing.packing_checks(bad, df, capacities(spark, 64)).where("capacity_id is not null").first()
    assert (r.n_over, r.n_texts) == (1, 3)


def test_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 40, "")] * 5 + [(2, None, ""), (None, 200, ""), (None, 200, "")], TYPE)
    for f in (packing.pack, packing.harmonic):
        rows = f(df, capacities(spark, 64)).collect()
        used = defaultdict(int)
        for r in rows:
            if r.n_tokens:
                used[r.bin_id] += r.n_tokens
        assert sum(r.n_tokens for r in rows) == 5 * 40 + 400 and max(used.values()) <= 64
