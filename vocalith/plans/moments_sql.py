"""SQL that reads times of mixed forms, independently of the operator: one full pattern a form, zones by the database's own tables."""

from __future__ import annotations

from vocalith.operators.moments import MONTHS

_WIDE = ("０１２３４５６７８９：／．－＋−–", "0123456789:/.-+--")
_REGION = r"[a-z]+/[a-z_]+(?:/[a-z_]+)?"
_REST = (
    r"(?:(?:t|,? |,? ?(?:à|um|at) )(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: uhr)? ?([ap]\.?m\b\.?)?"
    rf"(?: ?(z|utc|[+-]\d{{2}}(?::?\d{{2}})?|[a-z]{{2,5}}|{_REGION}))?(?: ?\[({_REGION})\])?)?"
)
_COMPACT = r"t(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()" rf"(?: ?(z|utc|[+-]\d{{2}}(?::?\d{{2}})?|[a-z]{{2,5}}|{_REGION}))?(?: ?\[({_REGION})\])?"
#: Forms of dates: the pattern, and which of its groups are year, month and day (s: slashes, in the site's order).
_FORMS = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd"),
    (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "ymd"),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"),
    (r"(\d{4})(\d{2})(\d{2})", "ymd"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", "s"),
    (r"(\d{1,2})\. ?(\d{1,2})\. ?(\d{4}|\d{2})", "dmy"),
    (r"(\d{4}) ?[年년] ?(\d{1,2}) ?[月월] ?(\d{1,2}) ?[日일]", "ymd"),
    (r"(?:\pL+\.?,? )?(\d{1,2})\.? (?:de )?(\pL+)\.?,? (?:de )?(\d{4})", "dmy"),
    (r"(?:\pL+, )?(\pL+)\.? (\d{1,2}),? (\d{4})", "mdy"),
)
_NAMES = "['a', 'b', 'c', 'h', 'mi', 's', 'f', 'half', 'zone', 'region']"


def _offset(zone: str, seconds: str) -> str:
    return f"(cast(epoch(timezone({zone}, to_timestamp({seconds}))) as bigint) - ({seconds}))"


def read_sql(rows: str) -> str:
    """CTEs ``rd``: ``rows`` (a select of table_name, row_id, k, site_id, t, ts) with x.us (wall time or instant), x.kind and the site's columns; only texts that state a moment."""
    months = "case lower(m) " + " ".join(f"when '{w}' then {i}" for i, forms in enumerate(MONTHS, 1) for w in forms.split()) + " else try_cast(m as int) end"
    tries = []
    for pattern, order in _FORMS:
        for rest in (_REST, _COMPACT):
            y, m, d = {"ymd": "abc", "dmy": "cba", "mdy": "cab", "s": "cab"}[order]
            full = f"^{pattern}{rest}$".replace("'", "''")
            swap = order == "s"
            parts = f"'y': g.{y}, 'm': {'case when o = ' + chr(39) + 'DMY' + chr(39) + ' then g.b when o = ' + chr(39) + 'YMD' + chr(39) + ' and length(g.c) = 2 then g.b else g.a end' if swap else 'g.' + m}, 'd': {'case when o = ' + chr(39) + 'DMY' + chr(39) + ' then g.a when o = ' + chr(39) + 'YMD' + chr(39) + ' and length(g.c) = 2 then g.c else g.b end' if swap else 'g.' + d}"
            if swap:
                parts = parts.replace(f"'y': g.{y}", "'y': case when o = 'YMD' and length(g.c) = 2 then g.a else g.c end")
            tries.append(f"when regexp_matches(x, '{full}', 'i') then (select {{{parts}, 'h': g.h, 'mi': g.mi, 's': g.s, 'f': g.f, 'half': g.half, 'zone': g.zone, 'region': g.region}} from (select regexp_extract(x, '{full}', {_NAMES}, 'i') as g))")
    return f"""stated as ({rows}), txt as (select stated.*, tz_name, std_abbr, dst_abbr, coalesce(date_order, 'DMY') as o, trim(regexp_replace(translate(t, '{_WIDE[0]}', '{_WIDE[1]}'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g')) as x
 from stated left join sites using (site_id)),
 parts as (select *, case {" ".join(tries)} end as p from txt),
 nums as (select *, p.m as m, try_cast(p.y as int) + case when length(p.y) = 2 then 2000 else 0 end as yy, try_cast(p.d as int) as dd, coalesce(try_cast(nullif(p.h, '') as int), 0) as hh, coalesce(try_cast(nullif(p.mi, '') as int), 0) as mm, coalesce(try_cast(nullif(p.s, '') as int), 0) as ss, cast(rpad(left(coalesce(p.f, ''), 6), 6, '0') as bigint) as ff from parts),
 dates as (select *, try_cast(printf('%04d-%02d-%02d', yy, {months}, dd) as date) as dt, case when coalesce(p.half, '') = '' then hh when hh between 1 and 12 then hh % 12 + case when lower(p.half[1]) = 'p' then 12 else 0 end end as h24 from nums),
 walls as (select *, case when regexp_full_match(x, '(\\d{{9,10}}|\\d{{12,13}}|\\d{{15,16}})(\\.\\d+)?') then
   cast(regexp_extract(x, '^\\d+') as bigint) * case when length(regexp_extract(x, '^\\d+')) <= 10 then 1000000 when length(regexp_extract(x, '^\\d+')) <= 13 then 1000 else 1 end
   + cast(rpad(left(regexp_extract(x, '\\.(\\d+)$', 1), 6), 6, '0') as bigint) * case when length(regexp_extract(x, '^\\d+')) <= 10 then 1000000 when length(regexp_extract(x, '^\\d+')) <= 13 then 1000 else 1 end // 1000000 end as count_us,
   case when dt is not null and h24 < 24 and mm < 60 and ss < 60 then (cast(epoch(dt) as bigint) + h24 * 3600 + mm * 60 + ss) * 1000000 + ff end as wall_us, lower(coalesce(p.zone, '')) as z, coalesce(nullif(p.region, ''), case when p.zone like '%/%' then p.zone end) as reg from dates),
 rd as (select *, coalesce(count_us, wall_us) as us, case when count_us is not null then 'instant' when z in ('z', 'utc') or z[1] in ('+', '-') then 'offset' when reg is not null then 'region' when z <> '' then 'abbr' else 'local' end as kind,
   case when z[1] in ('+', '-') then case when z[1] = '-' then -1 else 1 end * (cast(z[2:3] as int) * 60 + coalesce(try_cast(nullif(replace(z[4:], ':', ''), '') as int), 0)) * 60 else 0 end as off_s from walls where coalesce(count_us, wall_us) is not null)"""


def _wall(us: str, zone: str) -> str:
    """Microseconds of a wall time in a zone; where it occurs twice or never, by the offset before the change."""
    s = f"({us} // 1000000)"
    a, b = _offset(zone, f"{s} - 86400"), _offset(zone, f"{s} + 86400")
    return f"(select {us} - 1000000 * (case when a = b or {_offset(zone, f'{s} - a')} = a then a when {_offset(zone, f'{s} - b')} = b then b else a end) from (select {a} as a, {b} as b))"


def p1_sql() -> str:
    rows = "select 'metadata' as table_name, meta_id as row_id, call_id as k, site_id, call_datetime as t, loaded_at as ts from metadata union all select 'call_durations', dur_id, call_id, site_id, call_datetime, received_at from call_durations"
    jan, jul = (_offset("tz_name", f"cast(epoch(make_date(cast(date_part('year', make_timestamp(us)) as int), {m}, 5)) as bigint)") for m in (1, 7))
    return f"""with {read_sql(rows)}, utc as (select table_name, row_id, case kind when 'instant' then us when 'offset' then us - off_s * cast(1000000 as bigint)
 when 'abbr' then case when upper(z) = upper(std_abbr) then us - 1000000 * least({jan}, {jul}) when upper(z) = upper(dst_abbr) then us - 1000000 * greatest({jan}, {jul}) when z = 'gmt' then us end
 when 'region' then case when reg in (select name from pg_timezone_names()) then {_wall("us", "reg")} end
 else case when tz_name is not null then {_wall("us", "tz_name")} end end as utc_us from rd) select * from utc where utc_us is not null"""


def days_cte(key: str) -> str:
    """CTEs ``rd`` and ``days`` (k, day): the date that the last loaded row of a call with one states."""
    rows = f"select 'metadata' as table_name, meta_id as row_id, {key} as k, site_id, call_datetime as t, loaded_at as ts from metadata where {key} is not null"
    return f"{read_sql(rows)}, days as (select k, arg_max(strftime(make_timestamp(us), '%Y-%m-%d'), (ts, row_id)) as day from rd group by k)"
