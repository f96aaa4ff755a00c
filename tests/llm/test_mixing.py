import random

import pytest

from vocalith.llm import mixing

TYPE = "doc_id bigint, source string, n_tokens bigint, target_share double"
TARGETS = "source string, target_share double, max_repeats int"


def test_water_fill():
    got = mixing.water_fill({"a": 100, "b": 100, "c": 10}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1, "b": 4, "c": 2}, 200)
    assert got["c"] == 20 and got["a"] == 100 and got["b"] == pytest.approx(80)
    assert mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20}
    assert mixing.water_fill({"a": 0, "b": 5}, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}, 10) == {"a": 0, "b": 10}


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, 0.0) for d in docs], TYPE), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice((" Big", "big", "BIG ")), rng.randrange(1, 200)) for i in range(4000)] + [(10_000 + i, "mid", rng.randrange(1, 200)) for i in range(800)] + [(20_000 + i, "tiny", 50) for i in range(5)] + [(30_000, None, 9), (30_001, "other", 9), (30_002, " ", 9)]
    sized, targets = frames(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.1, 2)])
    mixed = mixing.mix(sized, targets)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"big", "mid", "tiny"}
    assert all(r.repeats == 4 for r in rows if r.source == "tiny")
    assert max(r.repeats for r in rows if r.source == "mid") <= 3 and all(r.repeats == 1 for r in rows if r.source == "big")
    report = {r.source: r for r in mixing.mix_report(mixed, sized, targets).collect()}
    plan = {r.source: r for r in mixing.plan_mix(sized, targets).collect()}
    for s in ("big", "mid", "tiny"):
        assert abs(report[s].mixed_tokens - plan[s].wanted_tokens) <= 200
    assert report["tiny"].clamped and not report["big"].clamped
    assert report["big"].actual_share / report["mid"].actual_share == pytest.approx(0.5 / 0.3, rel=0.02) or report["mid"].clamped
    assert report["absent"].mixed_tokens == 0
    again = {(r.doc_id, r.repeats) for r in mixing.mix(sized, targets).collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}
    assert again != {(r.doc_id, r.repeats) for r in mixing.mix(sized, targets, seed=8).collect()}


def test_empty(spark):
    sized, targets = frames(spark, [], [("a", 1.0, 2)])
    assert mixing.mix(sized, targets).count() == 0
    assert [r.mixed_tokens for r in mixing.mix_report(mixing.mix(sized, targets), sized, targets).collect()] == [0]
