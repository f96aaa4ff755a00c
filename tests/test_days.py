from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest

from vocalith.operators import segments as sg
from vocalith.operators.moments import read_moment
from vocalith.plans.reference import QUERIES

SF = "/root/testdata/sf0.001"


def test_written_date_of_the_last_readable_row(spark):
    t = lambda d: datetime(2024, 6, d)
    rows = [
        (1, " c1", "A", "2024-03-01T23:30:00-08:00", t(2)), (2, "C1\t", "A", "no time", t(3)),  # written date, though it is March 2 in UTC; the unreadable row doesn't count
        (3, "C2", "A", "03/04/2024 10:00", t(1)), (4, "C2", "B", "03/04/2024 10:00", t(2)),  # MDY, then DMY
        (5, "C3", None, "03/04/2024", t(1)), (6, "C4", "A", None, t(1)), (7, None, "A", "2024-01-01", t(1)), (8, "C5", "A", "-", t(1)), (9, "C6", "A", "1709337600", t(1)),
    ]
    meta = spark.createDataFrame(rows, "meta_id bigint, call_id string, site_id string, call_datetime string, loaded_at timestamp")
    sites = spark.createDataFrame([("A", "MDY"), ("B", "DMY")], "site_id string, date_order string")
    assert {r.call_id: r.day for r in sg.call_days(meta, sites).collect()} == {"C1": "2024-03-01", "C2": "2024-04-03", "C3": "2024-04-03", "C6": "2024-03-02"}


@pytest.fixture(scope="module")
def calls(spark):
    """call -> (subject, flag, day), in plain Python."""
    order = {r.site_id: r.date_order for r in spark.read.parquet(f"{SF}/sites.parquet").collect()}
    out, last = {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/metadata.parquet").collect(), key=lambda r: (r.loaded_at, r.meta_id)):
        if not (key := (r.call_id or "").strip().upper()):
            continue
        us = read_moment(r.call_datetime, order.get(r.site_id) or "DMY")[0]
        if us is not None:
            last[key] = (date(1970, 1, 1) + timedelta(days=us // 86_400_000_000)).isoformat()
        flag = (r.is_assessment or "").strip(" ").lower()
        out[key] = (r.subject_id, flag in ("t", "true", "1", "yes", "y"))
    return {k: (*v, last.get(k)) for k, v in out.items()}


def ident(call):
    return "_".join(x for x in (call[0], call[2] or "NaT") if x is not None)


def test_levels_by_brute_force(spark, calls):
    assert {(r.call_id, r.subject_id, r.day) for r in QUERIES["call_type_filter"](spark, SF).collect()} == {(k, s, d) for k, (s, f, d) in calls.items() if f}
    keys = [(r.audio_file_id or "").strip().upper() for r in spark.read.parquet(f"{SF}/recognition_results.parquet").select("audio_file_id").collect()]
    want = Counter(ident(calls[k]) for k in keys if k in calls)
    assert {r.id: r.n_segments for r in QUERIES["level_day"](spark, SF).collect()} == want
    timing = {r.id for r in QUERIES["ms_timing_day"](spark, SF).collect()}
    assert timing and timing <= set(want)
    split = QUERIES["call_activity_split"](spark, SF).collect()
    assert {r.id for r in split} == timing and all(f"{r.subject_id}_{r.date}" == r.id for r in split if not r.id.startswith("_"))


def test_scores_by_brute_force(spark, calls):
    days, weeks = defaultdict(list), defaultdict(list)
    for r in QUERIES["kaldi_confidence_segment"].__globals__["_word_scores"](spark, SF).where("conf is not null").collect():
        if r.call_id in calls:
            subject, _, day = calls[r.call_id]
            days[subject, day].append(r.conf)
            d = date.fromisoformat(day) if day else None
            weeks[subject, (d - timedelta(days=d.weekday())).isoformat() if d else None].append(r.conf)
    for name, at, want in (("kaldi_confidence_day", "day", days), ("kaldi_confidence_week", "week", weeks)):
        got = {(r.subject_id, r[at]): r.conf_mean for r in QUERIES[name](spark, SF).collect()}
        assert got == {k: pytest.approx(sum(v) / len(v), abs=2e-6) for k, v in want.items()}
