"""SQL of the rejects of problem 4."""

from __future__ import annotations

_NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
#: One field of a CSV record, and a whole record of them.
_FIELD = r'"(?:[^"]|"")*"|[^",][^,]*|'
_RECORD = rf"^(?:{_FIELD})(?:,(?:{_FIELD}))*$"
#: A list literal in Python's notation as JSON: quotes that are escaped or stand in the other kind are kept apart first.
_PYTHON = r"""replace(replace(regexp_replace(regexp_replace(replace(t, '\''', chr(2)), '\bNone\b', 'null', 'g'), '"([^"'']*)''([^"'']*)"', '"\1' || chr(2) || '\2"', 'g'), '''', '"'), chr(2), '''')"""


def _unit(c: str) -> str:
    return f"coalesce(regexp_full_match({c}, '{_NUMBER}') and try_cast({c} as double) between 0 and 1, false)"


def _words(rows: str, name: str) -> str:
    """CTE ``name``: ``rows`` (row_id, t) with the reason that speaks against the literal t, if any."""
    keys = ("Duration", "Offset", "Word")
    lacks = " or ".join(f"not json_exists(r, '$.{k}')" for k in keys)
    ticks = " and ".join(f"coalesce(json_type(r, '$.{k}') = 'UBIGINT' or regexp_full_match(r->>'$.{k}', '\\d{{19,38}}') and json_type(r, '$.{k}') <> 'VARCHAR', false)" for k in ("Offset", "Duration"))
    return f"""{name} as (select row_id, case when t is null then null when l is null or not list_bool_and(list_append(list_transform(l, lambda r: json_type(r) = 'OBJECT'), true)) then 'quoting'
 when list_bool_or(list_append(list_transform(l, lambda r: {lacks}), false)) then 'column_count' when not list_bool_and(list_append(list_transform(l, lambda r: coalesce(json_type(r, '$.Word') = 'VARCHAR', false) and {ticks}), true)) then 'value' end as reason
 from (select row_id, t, case when js is not null and json_type(js) = 'ARRAY' then cast(js as json[]) end as l from (select row_id, t, case when json_valid(t) then cast(t as json) when json_valid({_PYTHON}) then cast({_PYTHON} as json) end as js from ({rows}))))"""


def rejects_sql() -> dict[str, str]:
    field = _FIELD.replace("'", "''")
    record = _RECORD.replace("'", "''")
    values = f"regexp_full_match(f[2], '\\d+') and regexp_full_match(f[6], '\\d+') and regexp_full_match(f[7], '\\d+') and {_unit('f[5]')}"
    ctes = f"""{_words("select result_id as row_id, word_timing as t from recognition_results", "rr")},
 ln as (select line_id as row_id, string_split(coalesce(conf_scores, ''), ' ') as f from conf_sym), lp as (select row_id, f, string_split(f[1], '_') as p from ln),
 lr as (select row_id, case when len(f) <> 6 then 'column_count' when not coalesce(len(p) = 4 and regexp_full_match(p[3], '[0-9]+') and regexp_full_match(p[4], '[0-9]+') and try_cast(p[3] as decimal(38,0)) < try_cast(p[4] as decimal(38,0)), false) or not {_unit("f[6]")} then 'value' end as reason from lp),
 raw as (select raw_id as row_id, coalesce(line, '') as line, regexp_matches(coalesce(line, ''), '{record}', 's') as sound from raw_results),
 fld as (select row_id, sound, case when sound then list_transform(regexp_extract_all(',' || line, ',({field})', 1, 's'), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) end as f from raw),
 {_words("select row_id, nullif(trim(f[8]), '') as t from fld where len(f) = 8", "rw")},
 rs as (select fld.row_id, case when not sound then 'quoting' when len(f) <> 8 then 'column_count' when not ({values}) or rw.reason is not null then 'value' end as reason from fld left join rw on fld.row_id = rw.row_id)"""
    bad = "select 'recognition_results' as table_name, row_id, reason from rr where reason is not null union all select 'conf_sym', row_id, reason from lr where reason is not null union all select 'raw_results', row_id, reason from rs where reason is not null"
    return {
        "p4_found": f"with {ctes} {bad}",
        "p4_loaded_lines": f"""with {ctes} select line_id, call_id, line_no, received_at, f[1] as segment_id, try_cast(p[3] as decimal(38,0)) as segment_start, try_cast(p[4] as decimal(38,0)) as segment_end, f[2:5] as middle, try_cast(f[6] as double) as confidence
 from conf_sym join lp on line_id = lp.row_id join lr on line_id = lr.row_id where reason is null""",
    }
