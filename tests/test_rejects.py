import ast
import json
import random
import re

from pyspark.sql import functions as F

from vocalith.functions.literals import json_notation, with_list, with_word_list
from vocalith.operators import rejects as rj


def reason(v):
    """The rules again, in plain Python."""
    if v is None:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            x = read(v)
            break
        except Exception:
            x = None
    if not isinstance(x, list) or not all(isinstance(r, dict) for r in x):
        return "quoting"
    if any(k not in r for r in x for k in ("Word", "Offset", "Duration")):
        return "column_count"
    ok = all(type(r[k]) is int and r[k] >= 0 for r in x for k in ("Offset", "Duration")) and all(type(r["Word"]) is str for r in x)
    return None if ok else "value"


GOOD = "[{'Duration': 1, 'Offset': 2, 'Word': \"it's\"}, {'Word': 'a, {b}: [c]', 'Offset': 0, 'Duration': 5, 'Phones': [{'Ph': 'X', 'Offset': 1}]}]"
CASES = [
    GOOD, "[]", "[ ]", '[{"Word":"x","Offset":1,"Duration":2}]', "[{'Word': 'it\\'s', 'Offset': 1, 'Duration': 2}]", "[{'Word': 'a\"b', 'Offset': 1, 'Duration': 2}]", None, "", "nan", "None", "[None]", "{'Word': 'a', 'Offset': 1, 'Duration': 2}",
    "[{'Word': 'a', 'Offset': 1}]", "[{}]", "[{'Word': 'a', 'Offset': '1', 'Duration': 2}]", "[{'Word': 'a', 'Offset': 1.5, 'Duration': 2}]", "[{'Word': 'a', 'Offset': 1.0, 'Duration': 2}]", "[{'Word': 'a', 'Offset': -1, 'Duration': 2}]", "[{'Word': None, 'Offset': 1, 'Duration': 2}]", "[{'Word': 5, 'Offset': 1, 'Duration': None}]",
    "[{'Word': 'None', 'Offset': 1, 'Duration': 2, 'x': None, 'y': True}]", GOOD + "]", GOOD + ", []", GOOD[:-1], GOOD[1:], "[" + GOOD + "]", GOOD + " x", "[{'Word': 'a'b', 'Offset': 1, 'Duration': 2}]", "[{'Word: 'a', 'Offset': 1, 'Duration': 2}]", "[object Object]", "[{'Word': 'a', 'Offset': 1, 'Duration': 2}], 716039151",
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "i int, t string")
    got = {r.i: r.word_reason for r in with_word_list(df, "t").collect()}
    assert {i: got[i] for i in got} == {i: reason(v) for i, v in enumerate(CASES)}


def test_cut_anywhere(spark):
    cuts = [GOOD[:i] for i in range(len(GOOD))] + [GOOD[:i] + GOOD[i + 1 :] for i in range(len(GOOD))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cuts)], "i int, t string")
    got = {r.i: r.word_reason for r in with_word_list(df, "t").collect()}
    wrong = [(cuts[i], got[i], reason(cuts[i])) for i in got if got[i] != reason(cuts[i])]
    # Python joins neighbouring strings and takes bare names of one's own for none; both are no literals of records here
    assert all("'' " in c or re.search(r"'[A-Za-z]*''", c) or '""' in c for c, _, _ in wrong), wrong[:5]


def test_json_notation_keeps_strings(spark):
    text = "[{'a': None, 'b': 'None, True', 'c': \"it's None\", 'd': 'x\\'None\\'', 'e': False}]"
    got = with_list(spark.createDataFrame([(text,)], "t string"), "t", "v").select(F.expr("cast(v[0] as string)")).first()[0]
    assert json.loads(got) == {"a": None, "b": "None, True", "c": "it's None", "d": "x'None'", "e": False}
    assert spark.createDataFrame([("None",)], "t string").select(json_notation(F.col("t"))).first()[0] == "null"


def test_very_long_literal(spark):
    many = "[" + ", ".join(["{'Word': 'a', 'Offset': 1, 'Duration': None}"] * 60_000) + "]"
    assert with_word_list(spark.createDataFrame([(many,)], "t string"), "t").first().word_reason == "value"


def test_split_record():
    assert rj.split_record('a,"b ""c"", d",,"x\ny"') == (True, ["a", 'b "c", d', "", "x\ny"])
    assert rj.split_record('a,"b" c') == (False, None)
    assert rj.split_record('a,"b') == (False, None)
    assert rj.split_record("") == (True, [""])
    assert rj.split_record(None) == (None, None)
    assert rj.split_record('a,"",b"c"') == (True, ["a", "", 'b"c"'])


def tables(spark, rec, conf, raw):
    return (
        spark.createDataFrame(rec, "result_id bigint, word_timing string, reason string"),
        spark.createDataFrame(conf, "line_id bigint, conf_scores string, kind string"),
        spark.createDataFrame(raw, "raw_id bigint, line string, value string"),
    )


def test_rejects_and_load(spark):
    good = "C1,3,Hi.,hi,0.5,1,2,\"[{'Word': 'hi', 'Offset': 1, 'Duration': 2}]\""
    raw = [(1, good, ""), (2, good.replace("0.5", "1.5"), ""), (3, good + ",9", ""), (4, good[:-1], ""), (5, "C1,3,,,5e-1,1,2,", ""), (6, good.replace("'Offset': 1", "'Off': 1"), ""), (7, None, ""), (8, good.replace(",3,", ",x,"), "")]
    conf = [(1, "a_b_1_2 1 2 3 w 0.5", ""), (2, "a_b_2_2 1 2 3 w 0.5", ""), (3, "a_b_1_2 1 2 3 w 0.5 ", ""), (4, "a_b_1_2 1 2 3 w .5e0", ""), (5, "a_b_1_2 1 2 3 w inf", ""), (6, None, ""), (7, "a_b_c_1_2 1 2 3 w 1", ""), (8, "a_b_1_2 1 2 3 w 0.5f", "")]
    rec = [(1, GOOD, ""), (2, None, ""), (3, "nan", ""), (4, "[{}]", "")] + [(100 + i, "None", "") for i in range(50)]
    frames = tables(spark, rec, conf, raw)
    found = rj.rejects(*frames)
    got = {(r.table_name, r.row_id, r.reason) for r in found.collect()}
    want = {("recognition_results", 3, "quoting"), ("recognition_results", 4, "column_count")} | {("recognition_results", 100 + i, "quoting") for i in range(50)}
    want |= {("conf_sym", i, "value") for i in (2, 5, 7, 8)} | {("conf_sym", i, "column_count") for i in (3, 6)}
    want |= {("raw_results", 2, "value"), ("raw_results", 3, "column_count"), ("raw_results", 4, "quoting"), ("raw_results", 6, "value"), ("raw_results", 7, "column_count"), ("raw_results", 8, "value")}
    assert got == want
    loaded = {r.raw_id: r for r in rj.load_raw(frames[2], found).collect()}
    assert set(loaded) == {1, 5} and loaded[1].confidence == 0.5 and loaded[1].segment_number == 3


def test_load_all_tables(spark):
    digits, longer = "9" * 30, "9" * 50
    raw = [(1, f"C1,3,Hi.,hi,0.5,{digits},2,\"[{{'Word': 'hi', 'Offset': 1, 'Duration': 2, 'x': 1}}]\"", ""), (2, f"C1,3,,,5e-1,1,{longer},", "")]
    conf = [(1, "a_b_1_2 1 x 3 w 0.5", ""), (2, "a_b_2_2 1 2 3 w 0.5", ""), (3, None, ""), (4, f"a_b_1_{digits} 1 2 3 w .5e0", "")]
    rec = [(1, GOOD, ""), (2, None, ""), (3, "nan", ""), (4, "[{}]", ""), (5, "[]", ""), (6, "[{'Word': 'w', 'Offset': %s, 'Duration': 2}]" % digits, "")]
    frames = tables(spark, rec, conf, raw)
    found = rj.rejects(*frames)
    loaded = {r.raw_id: r for r in rj.load_raw(frames[2], found).collect()}
    assert loaded[1].offset == int(digits) and loaded[1].long_digits == {} and loaded[2].duration is None and loaded[2].long_digits == {"duration": longer}
    assert [w[:3] for w in loaded[1].word_timing] == [("hi", 1, 2)] and json.loads(loaded[1].word_timing[0].record)["x"] == 1 and loaded[2].word_timing is None
    lines = {r.line_id: (r.segment_id, r.segment_start, r.segment_end, r.middle, r.confidence) for r in rj.load_lines(frames[1], found).collect()}
    assert lines == {1: ("a_b_1_2", 1, 2, ["1", "x", "3", "w"], 0.5), 4: (f"a_b_1_{digits}", 1, int(digits), ["1", "2", "3", "w"], 0.5)}
    words = {r.result_id: r.word_timing for r in rj.load_words(frames[0]).collect()}
    assert set(words) == {1, 2, 5, 6} and words[2] is None and words[5] == [] and words[6][0].offset == int(digits) and words[6][0].record is None
    assert [w[:3] for w in words[1]] == [("it's", 2, 1), ("a, {b}: [c]", 0, 5)] and json.loads(words[1][1].record)["Phones"] == [{"Ph": "X", "Offset": 1}]


def test_empty(spark):
    assert rj.rejects(*tables(spark, [], [], [])).count() == 0


def test_random_fields_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        fields = ["".join(rng.choice('ab," \n') for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 6))]
        line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
        assert rj.split_record(line) == (True, fields)
