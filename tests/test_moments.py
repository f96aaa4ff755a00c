import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from vocalith.operators import moments as m

EPOCH = dt.datetime(1970, 1, 1)


def us(*parts):
    return (dt.datetime(*parts) - EPOCH) // dt.timedelta(microseconds=1)


@pytest.mark.parametrize(
    ("text", "order", "local", "kind"),
    [
        ("2022-03-29T10:05:55.830", "MDY", us(2022, 3, 29, 10, 5, 55, 830000), "local"),
        ("2021-06-09T16:47:14.472 UTC", "MDY", us(2021, 6, 9, 16, 47, 14, 472000), "offset"),
        ("20210421T000627Z", "MDY", us(2021, 4, 21, 0, 6, 27), "offset"),
        ("17/07/20 12:07\xa0PM", "DMY", us(2020, 7, 17, 12, 7), "local"),
        ("07/17/2020, 12:07:01 a.m.", "MDY", us(2020, 7, 17, 0, 7, 1), "local"),
        ("20/07/17 1:07pm", "YMD", us(2020, 7, 17, 13, 7), "local"),
        ("30.10.2021 15:48:03.073", "DMY", us(2021, 10, 30, 15, 48, 3, 73000), "local"),
        ("6 Nov 2021 03:44 PM PDT", "MDY", us(2021, 11, 6, 15, 44), "abbr"),
        ("Sun, 10 Jul 2022 13:02:08 -0400", "MDY", us(2022, 7, 10, 13, 2, 8), "offset"),
        ("October 2, 2021 12:17:38 PM", "MDY", us(2021, 10, 2, 12, 17, 38), "local"),
        ("11. April 2021, 20:17 Uhr", "DMY", us(2021, 4, 11, 20, 17), "local"),
        ("30 octobre 2021 à 18h18", "DMY", us(2021, 10, 30, 18, 18), "local"),
        ("8 de marzo de 2021, 8:19", "DMY", us(2021, 3, 8, 8, 19), "local"),
        ("２０２０年７月２６日 １６:４０", "YMD", us(2020, 7, 26, 16, 40), "local"),
        ("2021-02-08 20:35:19 America/New_York", "MDY", us(2021, 2, 8, 20, 35, 19), "region"),
        ("2023-12-12T15:00:33-05:00[America/New_York]", "MDY", us(2023, 12, 12, 15, 0, 33), "offset"),
        ("2024-09-14", "YMD", us(2024, 9, 14), "local"),
        ("1660676579.788", "MDY", 1660676579788000, "instant"),
        ("1702403682824", "MDY", 1702403682824000, "instant"),
        ("1601825746844068", "MDY", 1601825746844068, "instant"),
        (" 2021-10-30T12:00:07.892173887\n", "DMY", us(2021, 10, 30, 12, 0, 7, 892173), "local"),
    ],
)
def test_forms(text, order, local, kind):
    assert m.read_moment(text, order)[:2] == (local, kind)


@pytest.mark.parametrize("text", [None, "", " ", "pending", "2021-05", "14:19", "2021-02-29 09:37:00", "2020-13-04T08:00:00", "2023-04-11T27:10:00Z", "2021-11-09 12:37:75", "0000-00-00 00:00:00", "call 33", "13/13/2021", "1/2/2021 13:00 PM", "2021-01-01T00:00:00+25:00", "x" * 50_000])
def test_no_moment(text):
    assert m.read_moment(text, "MDY")[0] is None


def test_minus_sign_offset():
    assert m.read_moment("2022-01-17 13:41:15−05:30", "MDY")[3] == -(5 * 60 + 30) * 60_000_000


def test_wall_times_at_clock_changes(spark):
    """Twice or never: the offset before the change, as with fold 0."""
    cases = [(z, d) for z, d in (("America/New_York", dt.datetime(2021, 3, 14, 2, 30)), ("America/New_York", dt.datetime(2021, 11, 7, 1, 30)), ("Europe/Berlin", dt.datetime(2021, 3, 28, 2, 15)), ("Europe/Berlin", dt.datetime(2021, 10, 31, 2, 15)), ("Australia/Sydney", dt.datetime(2021, 10, 3, 2, 30)), ("America/St_Johns", dt.datetime(2021, 7, 1, 12, 0)))]
    rows = [(z, (d - EPOCH) // dt.timedelta(microseconds=1), int(d.replace(tzinfo=ZoneInfo(z)).timestamp() * 1_000_000)) for z, d in cases]
    df = spark.createDataFrame(rows, "z string, local bigint, want bigint").withColumn("got", m.wall_to_utc(F.col("local"), F.col("z")))
    assert all(r.got == r.want for r in df.collect())


def sites(spark):
    return spark.createDataFrame([("a", "America/New_York", "MDY", "EST", "EDT"), ("b", "Asia/Tokyo", "YMD", "JST", None)], "site_id string, tz_name string, date_order string, std_abbr string, dst_abbr string")


def test_normalise(spark):
    rows = [(1, "a", "2021-07-01 12:00:00 EDT"), (2, "a", "2021-07-01 12:00:00"), (3, "b", "2021-07-01 12:00:00 JST"), (4, "b", "2021-07-01 12:00:00 EDT"), (5, None, "2021-07-01 12:00:00"), (6, None, "2021-07-01T12:00:00Z"), (7, "a", None), (2, "a", "2021-07-01 12:00:00"), (8, "a", "2021-07-01 12:00:00 Nowhere/Land")]
    df = spark.createDataFrame([(i, s, t, dt.datetime(2021, 7, 1, 17, 0), "clash") for i, s, t in rows], "meta_id bigint, site_id string, call_datetime string, loaded_at timestamp, tz_name string")
    got = sorted((r.row_id, r.utc_us) for r in m.normalise(df.select("meta_id", "site_id", "call_datetime", "loaded_at", "tz_name"), "meta_id", "call_datetime", "loaded_at", sites(spark)).collect())
    noon = us(2021, 7, 1, 12)
    hour = 3_600_000_000
    assert got == [(1, noon + 4 * hour), (2, noon + 4 * hour), (2, noon + 4 * hour), (3, noon - 9 * hour), (6, noon)]


def test_estimate_without_declared_zone(spark):
    """The history is found from ingestion times alone, in summer and in winter."""
    rows = []
    for site, zone in (("a", "America/New_York"), ("b", "Asia/Tokyo")):
        for day in range(40):
            wall = dt.datetime(2021, 1, 1, 9, 0) + dt.timedelta(days=day * 9, minutes=day)
            utc = wall.replace(tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc).replace(tzinfo=None)
            rows.append((site, (wall - EPOCH) // dt.timedelta(microseconds=1), utc + dt.timedelta(minutes=3 if day % 10 else 60 * 24 * 20)))
    df = spark.createDataFrame(rows, "site_id string, local_us bigint, loaded_at timestamp")
    zones = spark.createDataFrame([("America/New_York",), ("America/Phoenix",), ("Asia/Tokyo",), ("Europe/Berlin",), ("America/Chicago",)], "tz_name string")
    got = {r.site_id: (r.zone, r.n_violations) for r in m.estimate_zones(df, "site_id", "loaded_at", zones).collect()}
    assert got == {"a": ("America/New_York", 4), "b": ("Asia/Tokyo", 4)}


def test_empty(spark):
    df = spark.createDataFrame([], "meta_id bigint, site_id string, call_datetime string, loaded_at timestamp")
    assert m.normalise(df, "meta_id", "call_datetime", "loaded_at", sites(spark)).count() == 0


def test_estimate_fills_a_site_without_zone(spark):
    from datetime import datetime

    sites = spark.createDataFrame([("X", None, "DMY", None, None), ("B", "Asia/Tokyo", "DMY", "JST", None), ("N", "America/New_York", "MDY", "EST", "EDT")], "site_id string, tz_name string, date_order string, std_abbr string, dst_abbr string")
    rows = [(i, "X", f"2024-01-{i:02d} 10:00", datetime(2024, 1, i, 1, 10)) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "row bigint, site_id string, t string, got timestamp")
    from vocalith.operators.moments import normalise

    want = {i: 1704067200000000 + (i - 1) * 86_400_000_000 + 3_600_000_000 for i in range(1, 20)}  # 01:00 UTC
    assert {r.row_id: r.utc_us for r in normalise(df, "row", "t", "got", sites).collect()} == want


def planted(spark, zone_of_day, declared):
    """A site whose wall times follow zone_of_day(day), ingested within 12 minutes; some texts name their offset."""
    rows = []
    for day in range(400):
        for k in range(3):
            zone = ZoneInfo(zone_of_day(day))
            wall = dt.datetime(2021, 1, 1, 9, 7) + dt.timedelta(days=day, hours=k, minutes=day % 50)
            utc = wall.replace(tzinfo=zone).astimezone(dt.timezone.utc).replace(tzinfo=None)
            text = wall.strftime("%Y-%m-%d %H:%M") if k else utc.strftime("%Y-%m-%dT%H:%MZ")
            rows.append((day * 3 + k, "X", text, utc + dt.timedelta(minutes=(day * 7 + k) % 12), int((utc - EPOCH).total_seconds()) * 1_000_000))
    df = spark.createDataFrame(rows, "row bigint, site_id string, t string, got timestamp, want bigint")
    sites = spark.createDataFrame([("X", declared, "YMD", None, None), *((z, z, "YMD", None, None) for z in ("Europe/London", "Europe/Berlin", "Asia/Tokyo", "America/New_York"))], "site_id string, tz_name string, date_order string, std_abbr string, dst_abbr string")
    return df, sites


def test_wrong_declaration_is_found(spark):
    """The estimate decides, an hour is told apart, and the mismatch is reported."""
    df, sites = planted(spark, lambda day: "Europe/London", "Europe/Berlin")
    read = m.read_sources([("x", df, "row", "t", "got")], sites)
    found = m.histories(read, sites).collect()
    assert [(r.entity, r.from_us, r.zone, r.declared, r.agrees) for r in found] == [("X", None, "Europe/London", "Europe/Berlin", False)]
    want = {r.row: r.want for r in df.collect()}
    assert {r.row_id: r.utc_us for r in m.normalise(df, "row", "t", "got", sites).collect()} == want


def test_history_that_changes(spark):
    """From a month on the site writes another zone's time."""
    df, sites = planted(spark, lambda day: "Europe/Berlin" if day < 181 else "Asia/Tokyo", "Europe/Berlin")
    read = m.read_sources([("x", df, "row", "t", "got")], sites)
    found = sorted((r.from_us or 0, r.zone, r.agrees) for r in m.histories(read, sites).collect())
    assert found == [(0, "Europe/Berlin", True), (us(2021, 7, 1), "Asia/Tokyo", False)]
    want = {r.row: r.want for r in df.collect()}
    assert {r.row_id: r.utc_us for r in m.normalise(df, "row", "t", "got", sites).collect()} == want


def test_unknown_regions_and_zones(spark):
    """A region or a declared zone that there isn't states no moment, and ends no query."""
    sites = spark.createDataFrame([("a", "Mars/Olympus", "DMY", None, None)], "site_id string, tz_name string, date_order string, std_abbr string, dst_abbr string")
    rows = [(1, "a", "2024-03-01 10:00 Europe/Atlantis"), (2, "a", "2024-03-01 10:00 europe/berlin"), (3, "a", "2024-03-01 10:00")]
    df = spark.createDataFrame([(i, s, t, dt.datetime(2024, 3, 1, 10)) for i, s, t in rows], "row bigint, site_id string, t string, got timestamp")
    assert {r.row_id: r.utc_us for r in m.normalise(df, "row", "t", "got", sites).collect()} == {2: us(2024, 3, 1, 9)}
