import datetime as dt
import random

from vocalith.operators import orphans


def brute(children, parents):
    clean = lambda k: k.strip().upper() or None if k else None
    by = {}
    for k, loaded, gone in parents:
        if clean(k):
            by.setdefault(clean(k), []).append((loaded, gone))
    out = []
    for t, i, k, at in children:
        if not clean(k):
            continue
        rows = by.get(clean(k))
        month = at.strftime("%Y-%m") if at else None
        if not rows:
            out.append((t, i, month, "missing"))
        elif at is None:
            out.append((t, i, month, "deleted"))
        elif not any(x is not None and x <= at and (y is None or y > at) for x, y in rows):
            out.append((t, i, month, "late" if all(x is not None and x > at for x, _ in rows) else "deleted"))
    return sorted(out, key=str)


def frames(spark, children, parents):
    out = {}
    for t in ("t1", "t2"):
        out[t] = (spark.createDataFrame([(i, k, at, "x") for n, i, k, at in children if n == t], "id bigint, fk string, at timestamp, loaded_at string"), "id", "fk", "at")
    return out, spark.createDataFrame(parents, "call_id string, loaded_at timestamp, deleted_at timestamp")


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = dt.datetime(2021, 1, 1)
    when = lambda: base + dt.timedelta(days=rng.randrange(120), hours=rng.randrange(3))
    parents = [(f" k{rng.randrange(12)}\t", None if rng.random() < 0.05 else when(), when() if rng.random() < 0.5 else None) for _ in range(40)]
    keys = [f"K{i}" for i in range(16)] + ["", None, "  "]
    children = [(rng.choice(("t1", "t2")), i, "k3" if i % 3 == 0 else rng.choice(keys), None if rng.random() < 0.03 else when()) for i in range(600)]
    got = sorted((tuple(r) for r in orphans.orphan_rows(*frames(spark, children, parents), salts=3).collect()), key=str)
    assert got == brute(children, parents)


def test_equal_times(spark):
    t = dt.datetime(2021, 5, 1)
    children = [("t1", 1, "a", t), ("t1", 2, "b", t), ("t1", 3, "c", t), ("t1", 3, "c", t)]
    parents = [("a", t, None), ("b", t - dt.timedelta(days=1), t), ("c", t, t)]
    got = sorted(tuple(r)[1:] for r in orphans.orphan_rows(*frames(spark, children, parents)).collect())
    assert got == [(2, "2021-05", "deleted"), (3, "2021-05", "deleted"), (3, "2021-05", "deleted")]


def test_empty_sides(spark):
    t = dt.datetime(2021, 5, 1)
    assert orphans.orphan_rows(*frames(spark, [], [("a", t, None)])).count() == 0
    got = orphans.orphan_rows(*frames(spark, [("t1", 1, "a", t)], []))
    assert [r.reason for r in got.collect()] == ["missing"]
    report = orphans.orphan_report(got).collect()
    assert [tuple(r) for r in report] == [("t1", "2021-05", "missing", 1)]
    assert [tuple(r) for r in orphans.orphan_keys(*frames(spark, [("t1", 1, "a", t), ("t1", 2, " A", t)], [])).collect()] == [("t1", "A", 2)]
