"""SQL of the nested records of problem 3, a CTE a level."""

from __future__ import annotations

#: A list literal in Python's notation as JSON, for the strings of the test data.
_PYTHON = r"""replace(replace(regexp_replace(regexp_replace(replace({t}, '\''', chr(2)), '\bNone\b', 'null', 'g'), '"([^"'']*)''([^"'']*)"', '"\1' || chr(2) || '\2"', 'g'), '''', '"'), chr(2), '''')"""


def _kids(v: str, member: str, through: str | None = None, literal: bool = False) -> str:
    child, text = f"{v}->'$.{member}'", f"({v}->>'$.{member}')"
    cases = [f"when json_type({child}) = 'ARRAY' then cast({child} as json[])", f"when json_type({child}) = 'OBJECT' then [{child}]"]
    if literal:
        for t in (text, _PYTHON.format(t=text)):
            cases.append(f"when json_type({child}) = 'VARCHAR' and json_valid({t}) and json_type(cast({t} as json)) = 'ARRAY' then cast(cast({t} as json) as json[])")
    if through:
        cases.append(f"when coalesce(json_type({child}), 'NULL') = 'NULL' and json_exists({v}, '$.{through}') then [{v}]")
    return f"case {' '.join(cases)} else cast([] as json[]) end"


def _walk(name: str, source: str, keep: str, of: str, number: str) -> str:
    return f"{name} as (select {keep}, v, n - 1 as {number} from (select {keep}, unnest(l) as v, generate_subscripts(l, 1) as n from (select *, {of} as l from {source})) where json_type(v) = 'OBJECT')"


def nested_sql(sql_key, sql_json: str, members: dict[str, dict[str, str]]) -> dict[str, str]:
    key = f"coalesce({sql_key('audio_file_id')}, '')"
    text_key = sql_key("(case when json_type(v->'$.audio_file_id') = 'VARCHAR' then v->>'$.audio_file_id' end)")
    at = "parent_id, audio_file_id"
    base = f"""with pay as (select payload_id as parent_id, case when json_type(d->'$.result') = 'OBJECT' then d->'$.result' else d end as v from (select payload_id, cast(payload as json) as d from result_payloads where json_valid(payload))),
 doc as (select parent_id, coalesce({text_key}, '') as audio_file_id, v from pay),
 {_walk("ch", "doc", at, _kids("v", "channels", "segments"), "c")}, {_walk("sg0", "ch", f"{at}, c", _kids("v", "segments"), "s")},
 sg as (select *, coalesce(try_cast(v->>'$.segment_number' as bigint), -1) as segment_number from sg0), {_walk("al", "sg", f"{at}, c, s, segment_number", _kids("v", "nbest", "word_timing"), "a")},
 {_walk("wd", "al", f"{at}, c, s, a, segment_number", _kids("v", "word_timing", literal=True), "w")}, {_walk("ph", "wd", f"{at}, c, s, a, w, segment_number", _kids("v", "Phones"), "p")},
 rr as (select result_id as parent_id, {key} as audio_file_id, coalesce(segment_number, -1) as segment_number, word_timing from recognition_results), rj as (select {at}, segment_number, j from {sql_json.format(rows="rr")} where len(j) > 0),
 {_walk("rw", "rj", f"{at}, segment_number", "j", "w")}, {_walk("rp", "rw", f"{at}, segment_number, w", _kids("v", "Phones"), "p")}"""

    def place(table: str, source: str, w: str, p: str) -> str:
        c, a = ("c", "a") if table == "result_payloads" else ("0", "0")
        return f"select '{table}' as table_name, {at}, {c} as channel_no, segment_number, {a} as alt_no, {w} as word_no, {p} as phone_no from {source}"

    def flat(table: str, source: str, label: str, up: str, path: str) -> str:
        values = ", ".join((f"(v->>'$.{m}')" if k == "string" else f"try_cast((v->>'$.{m}') as {k})") + f' as "{m.lower()}"' for m, k in members[path].items())
        return f"select '{table}' as table_name, {at}, segment_number, concat_ws('.', {label}) as label, concat_ws('.', {up}) as parent_label, {values} from {source}"

    rec, pay = "recognition_results", "result_payloads"
    return {
        "p3_found": f"{base} {place(rec, 'rw', 'w', '-1')} union all {place(rec, 'rp', 'w', 'p')} union all {place(pay, 'wd', 'w', '-1')} union all {place(pay, 'ph', 'w', 'p')}",
        "p3_segments": f"""{base} select '{rec}' as table_name, result_id as parent_id, {key} as audio_file_id, coalesce(segment_number, -1) as segment_number, '' as label, cast(null as varchar) as parent_label, "offset", duration from {rec} union all {flat(pay, 'sg', 'c, s', 'c', 'segment')}""",
        "p3_alternatives": f"{base} {flat(pay, 'al', 'c, s, a', 'c, s', 'alternative')}",
        "p3_words": f"{base} {flat(rec, 'rw', 'w', 'null', 'word')} union all {flat(pay, 'wd', 'c, s, a, w', 'c, s, a', 'word')}",
        "p3_phones": f"{base} {flat(rec, 'rp', 'w, p', 'w', 'phone')} union all {flat(pay, 'ph', 'c, s, a, w, p', 'c, s, a, w', 'phone')}",
    }
