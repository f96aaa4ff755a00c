"""Problem 1: timestamps written in mixed formats, precisions and time zones, as one UTC instant.

Three steps. ``read_sources`` takes a text apart by a small grammar of anchored patterns (date, clock, zone), in Arrow
batches. ``histories`` finds the offset history an entity's zoneless texts were written in: every candidate history
turns them into instants, lags to the row's ingestion outside those of texts with zones are violations, and the history with the
fewest is chosen; it may change from a month on. ``convert`` turns wall times into instants by it. A history that an entity
declares is held against the estimate and reported where they differ; it only has a credit of rows in its favour.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cache, reduce
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.session import cut_lineage

DAY_US = 86_400_000_000

#: Month names and their short forms in English, German, French and Spanish.
MONTHS = (
    "january jan januar januar janvier enero ene",
    "february feb februar februar février fevrier febrero",
    "march mar märz maerz mars marzo",
    "april apr avril abril abr avr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet julio",
    "august aug août aout agosto ago",
    "september sep sept septembre septiembre",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez décembre decembre diciembre dic",
)
_WIDE = str.maketrans("０１２３４５６７８９：／．－＋−–", "0123456789:/.-+--")
_SPACES = re.compile(r"[\s\u200b\ufeff]+")
_COUNT = re.compile(r"(\d{9,10}|\d{12,13}|\d{15,16})(?:\.(\d+))?")

#: Date patterns, tried in turn; the groups are named.
_DATES = tuple(
    re.compile(x)
    for x in (
        r"(?P<y>\d{4})([-./])(?P<m>\d{1,2})\2(?P<d>\d{1,2})(?!\d)",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?!\d)",
        r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<c>\d{4}|\d{2})(?!\d)",
        r"(?P<d>\d{1,2})\. ?(?P<m>\d{1,2})\. ?(?P<y>\d{4}|\d{2})(?!\d)",
        r"(?P<y>\d{4}) ?[年년] ?(?P<m>\d{1,2}) ?[月월] ?(?P<d>\d{1,2}) ?[日일]",
        r"(?:[^\W\d_]+\.?,? )?(?P<d>\d{1,2})\.? (?:de )?(?P<m>[^\W\d_]+)\.?,? (?:de )?(?P<y>\d{4})(?!\d)",
        r"(?:[^\W\d_]+, )?(?P<m>[^\W\d_]+)\.? (?P<d>\d{1,2}),? (?P<y>\d{4})(?!\d)",
    )
)
_ZONE = r" ?(?P<zone>z|utc|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}|[a-z]+/[a-z_]+(?:/[a-z_]+)?)?(?:\[(?P<region>[a-z]+/[a-z_]+(?:/[a-z_]+)?)\])?"
_CLOCKS = tuple(
    re.compile(x + _ZONE, re.I)
    for x in (
        r"(?:t|,? |,? ?(?:à|um|at) )(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?: uhr)? ?(?P<half>[ap]\.?m\.?(?![a-z]))?",
        r"t(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?",
    )
)
_MONTH_NO = {w: i for i, forms in enumerate(MONTHS, 1) for w in forms.split()}
_EPOCH = date(1970, 1, 1).toordinal()
_NOTHING = (None, None, None, None)


@cache
def _regions() -> dict[str, str]:
    """Names of time zones, by their lower case; a region that is none of them states no moment."""
    return {x.lower(): x for x in available_timezones()}


def _micros(fraction: str | None) -> int:
    return int((fraction or "0")[:6].ljust(6, "0"))


def _date(x: str, order: str | None) -> tuple[int | None, int]:
    """Days since 1970 of the date that ``x`` opens with, and where it ends."""
    for pattern in _DATES:
        if g := pattern.match(x):
            p = g.groupdict()
            if "a" in p:
                short = len(p["c"]) == 2
                if order == "YMD" and short:
                    y, m, d = p["a"], p["b"], p["c"]
                elif order == "DMY":
                    d, m, y = p["a"], p["b"], p["c"]
                else:
                    m, d, y = p["a"], p["b"], p["c"]
            else:
                y, m, d = p["y"], p["m"], p["d"]
            month = int(m) if m.isdigit() else _MONTH_NO.get(m.lower())
            if month is None:
                continue
            try:
                return date(int(y) + 2000 * (len(y) == 2), month, int(d)).toordinal() - _EPOCH, g.end()
            except ValueError:
                return None, 0
    return None, 0


def read_moment(text: str | None, order: str | None) -> tuple[int | None, str | None, str | None, int | None]:
    """(local_us, kind, zone_text, offset_us) of one text; all null if it states no moment."""
    if not text:
        return _NOTHING
    x = _SPACES.sub(" ", text.translate(_WIDE)).strip()
    if g := _COUNT.fullmatch(x):
        n = len(g[1])
        unit = 1_000_000 if n <= 10 else 1000 if n <= 13 else 1
        return int(g[1]) * unit + _micros(g[2]) * unit // 1_000_000, "instant", None, None
    days, end = _date(x, order.upper() if order else order)
    if days is None:
        return _NOTHING
    rest, us, zone, region = x[end:], 0, "", None
    if rest:
        g = next(filter(None, (c.fullmatch(rest) for c in _CLOCKS)), None)
        if not g:
            return _NOTHING
        p = g.groupdict()
        h, mi, s = int(p["h"]), int(p["mi"]), int(p["s"] or 0)
        if half := (p.get("half") or "")[:1].lower():
            if not 1 <= h <= 12:
                return _NOTHING
            h = h % 12 + 12 * (half == "p")
        if h > 23 or mi > 59 or s > 59:
            return _NOTHING
        us, zone, region = (h * 3600 + mi * 60 + s) * 1_000_000 + _micros(p["f"]), (p["zone"] or ""), p["region"]
    local = days * DAY_US + us
    low = zone.lower()
    if low in ("z", "utc"):
        return local, "offset", None, 0
    if low[:1] in ("+", "-") and low:
        hours, minutes = int(low[1:3]), int(low[3:].replace(":", "") or 0)
        if hours > 18 or minutes > 59:
            return _NOTHING
        return local, "offset", None, (-1 if low[0] == "-" else 1) * (hours * 60 + minutes) * 60_000_000
    if region or "/" in zone:
        name = _regions().get((region or zone).lower())
        return (local, "region", name, None) if name else _NOTHING
    return (local, "abbr", zone.upper(), None) if zone else (local, "local", None, None)


_moment_type = T.StructType([T.StructField("local_us", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("zone_text", T.StringType()), T.StructField("offset_us", T.LongType())])


@F.pandas_udf(_moment_type)
def _read(texts: pd.Series, orders: pd.Series) -> pd.DataFrame:
    memo: dict = {}
    found = []
    for key in zip(texts, orders):
        if key not in memo:
            memo[key] = read_moment(*key)
        found.append(memo[key])
    out = pd.DataFrame(found, columns=["local_us", "kind", "zone_text", "offset_us"], dtype=object)
    return out.astype({"local_us": "Int64", "offset_us": "Int64"})


_read_once = _read.asNondeterministic()  # else a filter on its result would run it twice


def read_moments(df: DataFrame, text: str, date_order: str, keep: list[str]) -> DataFrame:
    """keep + local_us (wall time in microseconds, or the instant), kind ('instant', 'offset', 'abbr', 'region', 'local'), zone_text, offset_us.

    Texts that state no existing calendar date, or an impossible time of day, or something else beside them, give
    nulls; so do null and blank texts. Fractions finer than a microsecond are cut off. Slashed dates follow
    ``date_order`` (MDY, DMY, YMD); with YMD and a four-digit year at the end the month comes first.
    """
    return df.select(*keep, _read_once(F.col(text), F.col(date_order)).alias("_r")).select(*keep, "_r.*")


def wall_to_utc(local_us: Column, zone: Column) -> Column:
    """Wall time in a zone as UTC; a time that occurs twice or never takes the offset in force just before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def instant_us(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without zone is UTC, whatever the session's zone."""
    if df.schema[c].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{c}`)")
    return F.unix_micros(c)


def _offset_at(utc_us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def _season_offsets(local_us: Column, zone: Column) -> tuple[Column, Column]:
    """Standard and summer offset of the zone in the year of a wall time."""
    year = F.year(F.timestamp_micros(local_us))
    a = _offset_at(F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(5), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))), zone)
    b = _offset_at(F.unix_micros(F.make_timestamp(year, F.lit(7), F.lit(5), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))), zone)
    return F.least(a, b), F.greatest(a, b)


@dataclass(frozen=True)
class Window:
    """Lags (ingestion minus moment, microseconds) that are no violation."""

    low_us: int = -300_000_000
    high_us: int = 7_200_000_000


def lag_windows(read: DataFrame, source: str, ingested_us: str, core: float = 0.6, least: int = 20) -> dict[str, Window]:
    """For each source the usual lags, learnt from rows whose text names its offset: from the first hundredth to ``core`` of them.

    Sources are a short list (tables, feeds). One with fewer than ``least`` such rows is left to the default window.
    """
    stated = F.when(F.col("kind") == "instant", F.col("local_us")).when(F.col("kind") == "offset", F.col("local_us") - F.col("offset_us"))
    lags = read.select(source, (F.col(ingested_us) - stated).alias("lag")).where("lag is not null")
    found = lags.groupBy(source).agg(F.count("*").alias("n"), F.percentile_approx("lag", [0.01, core], 10_000).alias("q")).where(F.col("n") >= least)
    return {r[source]: Window(r.q[0], r.q[1]) for r in found.collect()}


def zone_costs(local: DataFrame, entity: str, ingested_us: str, zones: list[str], windows: dict[str, Window] | None = None, source: str | None = None) -> DataFrame:
    """(entity, month, tz_name, n_rows, n_violations, spread): how each history of ``zones`` fits the entity's local times of a month.

    A violation is a lag outside the source's window; spread is the distance of lags from the window's middle, in seconds
    and at most a window's width, which tells histories apart that break nothing. Rows without ingestion time and texts
    without clock (midnight) say nothing. Every row is held against every history where it stands and the counters are
    summed map-side, so that an entity with any number of rows is months x zones of them.
    """
    windows, fallback = windows or {}, Window()
    pick = lambda f: (lambda c: c.otherwise(F.lit(f(fallback))) if windows else F.lit(f(fallback)))(_by_source(windows, source, f))
    low, high = pick(lambda w: w.low_us), pick(lambda w: w.high_us)
    middle, width = pick(lambda w: (w.low_us + w.high_us) // 2), pick(lambda w: max(1, w.high_us - w.low_us))
    candidates = F.array(*map(F.lit, zones)) if zones else F.array().cast("array<string>")
    timed = local.where(F.col(entity).isNotNull() & F.col(ingested_us).isNotNull() & F.col("local_us").isNotNull() & (F.pmod("local_us", F.lit(DAY_US)) != 0))
    each = timed.select(F.col(entity).alias("entity"), F.col("local_us"), F.col(ingested_us).alias("_in"), low.alias("_low"), high.alias("_high"), middle.alias("_mid"), width.alias("_width"), F.explode(candidates).alias("tz_name"))
    lag = each.withColumn("_lag", F.col("_in") - wall_to_utc(F.col("local_us"), F.col("tz_name"))).withColumn("month", F.date_trunc("month", F.timestamp_micros("local_us")))
    off = (F.col("_lag") < F.col("_low")) | (F.col("_lag") > F.col("_high"))
    far = F.floor(F.least(F.abs(F.col("_lag") - F.col("_mid")), F.col("_width")) / 1_000_000)
    return lag.groupBy("entity", F.unix_micros("month").alias("month"), "tz_name").agg(F.count("*").alias("n_rows"), F.sum(off.cast("bigint")).alias("n_violations"), F.sum(far).alias("spread"))


def _by_source(windows: dict[str, Window], source: str | None, f: Callable[[Window], int]) -> Column | None:
    out = None
    for name, w in windows.items():
        test = F.col(source) == F.lit(name)
        out = F.when(test, F.lit(f(w))) if out is None else out.when(test, F.lit(f(w)))
    return out


_history_type = "entity string, from_us bigint, zone string, n_rows bigint, n_violations bigint, declared string, declared_violations bigint, agrees boolean"


def best_history(costs: pd.DataFrame, trust: float, switch: float) -> list[tuple]:
    """Counters of one entity (month, tz_name, n_rows, n_violations, spread, own) -> its periods.

    The path through the months with the fewest violations, where a change of history costs ``switch`` of them. The
    declared history (own) is credited with ``trust`` of the rows; then the smaller spread decides, the declared one, the
    name. A declared history agrees where the data can't tell it from the chosen one.
    """
    names = sorted(costs["tz_name"].unique())
    months = sorted(costs["month"].unique())
    at = {z: i for i, z in enumerate(names)}, {m: i for i, m in enumerate(months)}
    rows, bad, spread = (np.zeros((len(months), len(names)), dtype=np.int64) for _ in range(3))
    i, j = costs["month"].map(at[1]).to_numpy(), costs["tz_name"].map(at[0]).to_numpy()
    rows[i, j], bad[i, j], spread[i, j] = costs["n_rows"], costs["n_violations"], costs["spread"]
    said = costs.loc[costs["own"], "tz_name"]
    own = at[0][said.iloc[0]] if len(said) else None
    cost = bad + 1e-3 * rows * spread / (1 + spread.max())
    if own is not None:
        cost[:, own] -= trust * rows[:, own] + 1e-9
    score, back = cost[0], []
    for c in cost[1:]:
        best = int(np.argmin(score))
        stay = score <= score[best] + switch
        back.append(np.where(stay, np.arange(len(names)), best))
        score = c + np.where(stay, score, score[best] + switch)
    path = [int(np.argmin(score))]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out = []
    begin = 0
    for k in range(1, len(path) + 1):
        if k == len(path) or path[k] != path[begin]:
            z = path[begin]
            span = slice(begin, k)
            theirs = int(bad[span, own].sum()) if own is not None else None
            same = own is not None and theirs == bad[span, z].sum() and spread[span, own].sum() == spread[span, z].sum()
            out.append((None if begin == 0 else int(months[begin]), names[z], int(rows[span, z].sum()), int(bad[span, z].sum()), names[own] if own is not None else None, theirs, bool(same)))
            begin = k
    return out


def estimate_histories(costs: DataFrame, declared: DataFrame | None = None, trust: float = 0.25, switch: float = 8.0) -> DataFrame:
    """(entity, from_us, zone, n_rows, n_violations, declared, declared_violations, agrees): the offset history of each entity, a row a period.

    from_us is the local time from which a zone holds, in steps of months; null for the first. ``costs`` is what
    ``zone_costs`` gave; ``declared`` (entity, tz_name) is only compared, unless ``trust`` gives it credit. One group is the
    counters of an entity, bounded by months x zones.
    """
    own = costs.withColumn("own", F.lit(False)).withColumn("_said", F.lit(None).cast("string"))
    if declared is not None:
        own = costs.join(declared.select(F.col("entity"), F.col("tz_name").alias("_said")).distinct(), "entity", "left").withColumn("own", F.coalesce(F.col("_said") == F.col("tz_name"), F.lit(False)))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        entity = pdf["entity"].iloc[0]
        return pd.DataFrame([(entity, *x) for x in best_history(pdf, trust, switch)], columns=["entity", "from_us", "zone", "n_rows", "n_violations", "declared", "declared_violations", "agrees"]).astype({"from_us": "Int64", "declared_violations": "Int64"})

    return own.drop("_said").groupBy("entity").applyInPandas(best, _history_type)


def estimate_zones(local: DataFrame, entity: str, ingested: str, zones: DataFrame) -> DataFrame:
    """entity, zone, n_rows, n_violations: the one history that fits an entity best, without declared ones and with the default window."""
    timed = local.withColumn("_in_us", instant_us(local, ingested))
    found = estimate_histories(zone_costs(timed, entity, "_in_us", zone_names(zones)), switch=float("inf"))
    return found.select(F.col("entity").alias(entity), "zone", "n_rows", "n_violations")


def known_zones(spark: SparkSession) -> set[str]:
    """Names of time zones that the engine can convert; any other would end the query."""
    return set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def zone_names(zones: DataFrame) -> list[str]:
    """The candidate histories: a list bounded by the number of time zones there are."""
    known = known_zones(zones.sparkSession)
    return sorted({r.tz_name for r in zones.select("tz_name").where("tz_name is not null").distinct().collect()} & known)


def read_sources(sources: list[tuple[str, DataFrame, str, str, str]], sites: DataFrame, entity: str = "site_id") -> DataFrame:
    """Every text of all ``sources`` (name, rows, id, text, ingestion column) read once: table_name, row_id, entity, in_us, the site's columns and the moment's.

    The result is written to the shared checkpoint folder, since windows, estimate and conversion all use it.
    """
    names = [r.tz_name for r in sites.select("tz_name").where("tz_name is not null").distinct().collect()]  # a list of zones
    known = sorted(known_zones(sites.sparkSession) & set(names))
    site = sites.select(F.col(entity).alias("entity"), F.when(F.col("tz_name").isin(*known), F.col("tz_name")).alias("tz_name"), "date_order", "std_abbr", "dst_abbr")
    rows = [df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), F.col(entity).alias("entity"), F.col(text).alias("_text"), instant_us(df, ingested).alias("in_us")) for name, df, row_id, text, ingested in sources]
    placed = reduce(DataFrame.unionByName, rows).join(site, "entity", "left").withColumn("_order", F.coalesce("date_order", F.lit("DMY")))
    kept = ["table_name", "row_id", "entity", "in_us", "tz_name", "std_abbr", "dst_abbr"]
    return cut_lineage(read_moments(placed, "_text", "_order", kept).where("local_us is not null"))


def histories(read: DataFrame, sites: DataFrame, entity: str = "site_id", trust: float = 0.25) -> DataFrame:
    """The offset histories of all entities of ``read_sources``; with ``trust`` 0 the declared ones have no say."""
    local = read.where("kind = 'local'")
    costs = zone_costs(local, "entity", "in_us", zone_names(sites), lag_windows(read, "table_name", "in_us"), "table_name")
    return estimate_histories(costs, sites.select(F.col(entity).alias("entity"), "tz_name"), trust)


def convert(read: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, row_id, utc_us) of what ``read_sources`` read, by the histories ``found``.

    The estimated history decides; where an entity has no rows to estimate from, the declared zone. A row whose entity has
    neither states no moment unless its text names an offset. An abbreviation that isn't the site's states none either.
    """
    spans = found.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("from_us", F.lit(-(2**63))).alias("from_us"), "zone"))).alias("_spans"))
    known = read.join(spans, "entity", "left").withColumn("_zone", F.expr("element_at(filter(_spans, x -> x.from_us <= local_us), -1).zone"))
    zone = F.coalesce("_zone", "tz_name")
    std, dst = _season_offsets(F.col("local_us"), zone)
    abbr = F.when(F.col("zone_text") == F.upper("std_abbr"), std).when(F.col("zone_text") == F.upper("dst_abbr"), dst).when(F.col("zone_text") == "GMT", F.lit(0).cast("bigint"))
    region = F.when(F.col("zone_text").isin(*sorted(known_zones(read.sparkSession))), wall_to_utc(F.col("local_us"), F.col("zone_text")))
    utc = (
        F.when(F.col("kind") == "instant", F.col("local_us"))
        .when(F.col("kind") == "offset", F.col("local_us") - F.col("offset_us"))
        .when(F.col("kind") == "abbr", F.col("local_us") - abbr)
        .when(F.col("kind") == "region", region)
        .otherwise(wall_to_utc(F.col("local_us"), zone))
    )
    return known.select("table_name", "row_id", utc.alias("utc_us")).where("utc_us is not null")


def normalise_sources(sources: list[tuple[str, DataFrame, str, str, str]], sites: DataFrame, entity: str = "site_id") -> DataFrame:
    """(table_name, row_id, utc_us): each row whose text states a moment. Repeated rows each come out; empty sources give none."""
    read = read_sources(sources, sites, entity)
    return convert(read, histories(read, sites, entity))


def normalise(df: DataFrame, row_id: str, text: str, ingested: str, sites: DataFrame, entity: str = "site_id") -> DataFrame:
    """(row_id, utc_us) of one table."""
    return normalise_sources([("", df, row_id, text, ingested)], sites, entity).select("row_id", "utc_us")
