import pytest

from vocalith import cli
from vocalith.operators import features as ft
from vocalith.sources import files, sinks

HEAD = "audio_file_id,segment_number,text,text_basic,confidence,offset,duration,word_timing\n"
ROW = "c{0},{1},\"Hi, there.\nYou.\",hi there you,0.{1},0,20000000,\"[{{'Word': 'hi', 'Offset': 1000000, 'Duration': 3000000}}]\"\n"


@pytest.fixture
def results(tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + ROW.format(1, 5) + ROW.format(2, 6))
    (tmp_path / "b.csv").write_text("order," + HEAD + "3," + ROW.format(1, 7) + "x,c9,y,,,z,1,2,\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.csv\n\n{tmp_path}/b.csv\n")
    return str(tmp_path / "list.txt")


def test_recognizer_results(spark, results):
    df = files.recognizer_results(spark, files.manifest(spark, results))
    rows = {(r.audio_file_id, r.segment_number): r for r in df.collect()}
    assert set(rows) == {("c1", 5), ("c2", 6), ("c1", 7), ("c9", None)}
    assert rows["c1", 7].order == 3 and rows["c1", 5].text == "Hi, there.\nYou." and "feature_id" not in df.columns
    assert files.recognizer_results(spark, []).count() == 0


def test_dumps(spark, tmp_path):
    for c in ("c1", "c2"):
        (tmp_path / "k" / c).mkdir(parents=True)
    (tmp_path / "k/c1/conf_sym.txt").write_text("a_b_100_300 1 2 3 w 0.5\nbroken\n")
    (tmp_path / "k/c1/word_phone_ali_timing.txt").write_text("\"a_b_0_350\n0 4 p q sil\n4 6 p q hi\n6 10 p q\n10 12 p q [noise]\n12 14 p q\n\"a_b_400_500\n0 4 p q yes\n")
    rows = files.confidence_lines(spark, str(tmp_path / "k")).collect()
    assert {(r.call_id, r.segment_id, r.start_ms, r.end_ms, r.conf) for r in rows} == {("c1", "a_b_100_300", 100, 300, 0.5), ("c1", "broken", None, None, None)}
    lines = files.alignments(spark, str(tmp_path / "k"))
    assert {(r.seg, r.start_ms) for r in lines.collect()} == {("a_b_0_350", 0), ("a_b_400_500", 400)} and lines.count() == 6
    assert sorted(r.value for r in ft.alignment_measures(lines.withColumnRenamed("call_id", "id")).where("kind = 'words'").collect()) == [100, 150]
    (tmp_path / "h/c1").mkdir(parents=True)
    (tmp_path / "h/c1/one.txt").write_text("s1 hello there\ns2\n")
    (tmp_path / "h/c1/two.txt").write_text("s1 hullo\n")
    assert {tuple(r) for r in files.hypotheses(spark, str(tmp_path / "h")).collect()} == {("c1", 0, "s1", "hello there"), ("c1", 0, "s2", ""), ("c1", 1, "s1", "hullo")}


def test_lists_and_dimensions(spark, tmp_path):
    (tmp_path / "x.dic").write_text("%\n1\tfunc\n2\tself\n%\nI\t1\t2\nwork*\t2\nyou know\t1\n")
    assert files.dictionary(str(tmp_path / "x.dic")) == [("i", "func"), ("i", "self"), ("work*", "self"), ("you know", "func")]
    (tmp_path / "stop.txt").write_text("the\n a \n\n")
    assert files.stop_words(spark, str(tmp_path / "stop.txt")) == ["the", "a"]
    (tmp_path / "d.csv").write_text("call_id,duration\nc1,1500\nc2,x\n")
    assert {r.call_id: r.duration_sec for r in files.call_durations(spark, str(tmp_path / "d.csv")).collect()} == {"c1": 1.5, "c2": None}
    (tmp_path / "m.csv").write_text("call_id,subject_id,call_datetime,is_assessment\nc1,s1,2021-02-03 04:05:06,t\nc2,s2,never,f\n")
    assert {r.call_id: str(r.day) for r in files.call_metadata(spark, str(tmp_path / "m.csv")).collect()} == {"c1": "2021-02-03", "c2": "None"}


def test_command_line(spark, results, tmp_path):
    out = str(tmp_path / "out")
    (tmp_path / "m.csv").write_text("call_id,subject_id,call_datetime,is_assessment\nC1,s1,2021-02-03 04:05:06,t\nC2,s2,2021-02-03 04:05:06,f\n")
    (tmp_path / "d.csv").write_text("call_id,duration_ms\nC1,60000\n")
    cli.main(["features", "--results", results, "--output_dir", out, "--feature_list", "verbosity", "lexical_diversity"])
    cli.main(["timing", "--results", results, "--output_dir", out, "-d", str(tmp_path / "d.csv"), "--metadata_path", str(tmp_path / "m.csv"), "--call_type", "assessment"])
    cli.main(["confidence", "--results", results, "--output_dir", out, "--level", "day", "--metadata_path", str(tmp_path / "m.csv")])
    cli.main(["aggregate", "--input_dir", f"{out}/timing_features", "--output_dir", out])
    read = lambda n: spark.read.option("header", True).csv(f"{out}/{n}").collect()
    assert {r.id for r in read("verbosity_features")} == {"C1", "C2", "C9"}
    timing = read("timing_features")
    assert [r.id for r in timing] == ["C1"] and float(timing[0].segs_per_min) == 2
    assert {r.id for r in read("asr_conf_features")} == {"s1_2021-02-03", "s2_2021-02-03"}
    assert [r.call_id for r in read("call_all_timing")] == ["C1"]


def test_sink_per_id(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, f double").select("f", "id")
    path = sinks.write_features(df, str(tmp_path), "pos", "parquet", per_id=True)
    assert path.endswith("pos_features") and spark.read.parquet(path).where("id = 'b'").first().f is None


def test_commands_by_level(spark, tmp_path):
    """Alignments, confidence lines and transcripts at levels; call activity; dictionaries and stop words from files."""
    for c in ("c1", "c2"):
        (tmp_path / "k" / c).mkdir(parents=True)
        (tmp_path / "k" / c / "conf_sym.txt").write_text(f"a_b_100_300 1 2 3 w 0.{c[1]}\na_b_300_400 1 2 3 w 0.9\n")
        (tmp_path / "k" / c / "word_phone_ali_timing.txt").write_text('"a_b_0_350\n0 4 p q sil\n4 6 p q hi\n6 10 p q\n10 12 p q [noise]\n12 14 p q\n"a_b_400_500\n0 4 p q yes\n')
        (tmp_path / "h" / c).mkdir(parents=True)
        (tmp_path / "h" / c / "one.txt").write_text("a_b_5_6 you know this\na_b_0_4 hello there\n")
        (tmp_path / "h" / c / "two.txt").write_text("a_b_0_4 hullo\n")
    (tmp_path / "m.csv").write_text("subject_id,call_id,week,date,time\ns1,c1,1,2021-02-03,10:00\ns1,c2,1,2021-02-04,09:00\ns1,c2,1,2021-02-04,09:00\n")
    (tmp_path / "d.csv").write_text("call_id,duration\nc1,30\nc2,60\n")
    (tmp_path / "x.dic").write_text("%\n1\tfunc\n%\nyou know\t1\n")
    out, meta = str(tmp_path / "out"), str(tmp_path / "m.csv")
    k, h = str(tmp_path / "k"), str(tmp_path / "h")
    cli.main(["alignments", "-i", k, "-o", out, "-l", "week", "-m", meta, "-d", str(tmp_path / "d.csv")])
    row = spark.read.parquet(f"{out}/word_phone_timing").first()
    assert (row.subject_id, row.week, row.total_duration, row.word_count, row.segment_count) == ("s1", "1", 90.0, 4, 4)
    cli.main(["lines", "-i", k, "-o", out, "-l", "subject", "-m", meta])
    assert [round(r.conf_mean, 6) for r in spark.read.parquet(f"{out}/asr_confidence").collect()] == [0.525]
    cli.main(["lines", "-i", k, "-o", out])
    assert {r.call_id: round(r.conf_min, 6) for r in spark.read.parquet(f"{out}/asr_confidence").collect()} == {"C1": 0.1, "C2": 0.2}
    cli.main(["transcripts", "-t", h, "-o", out, "-l", "day", "-m", meta, "-f", "verbosity"])
    rows = spark.read.parquet(f"{out}/verbosity_features").collect()
    assert {(r.subject_id, r.day): r.total_count for r in rows} == {("s1", "2021-02-03"): 3.0, ("s1", "2021-02-04"): 3.0}  # (5 + 1) / 2
    cli.main(["transcripts", "-t", h, "-o", out, "-f", "liwc", "--dictionary", str(tmp_path / "x.dic")])
    assert {r.call_id: r.func_liwc for r in spark.read.parquet(f"{out}/liwc_features").collect()} == {"C1": 0.1, "C2": 0.1}  # (1 / 5 + 0) / 2
    for level in ("subject", "week"):
        with pytest.raises(ValueError):
            cli.main(["lines", "-i", k, "-o", out, "-l", level])


def test_activity_command(spark, tmp_path):
    df = spark.createDataFrame([("s_1_2021-02-03", *map(float, range(15)), 7.0)], ["id", *ft.CALL_ACTIVITY, "more"])
    sinks.write_features(df, str(tmp_path), "timing")
    cli.main(["activity", "-i", f"{tmp_path}/timing_features", "-o", str(tmp_path)])
    row = spark.read.option("header", True).csv(f"{tmp_path}/day_all_call_act").first()
    assert (row.subject_id, row.date, float(row.segment_count)) == ("s_1", "2021-02-03", 0.0) and "more" not in row.asDict()


def test_headers_of_many_files(spark, tmp_path):
    """Blanks and signs in names, an empty file, a header of its own in each."""
    d = tmp_path / "with blank 50%"
    d.mkdir()
    for i in range(4):
        (d / f"f {i}.csv").write_text(("order," if i % 2 else "") + HEAD + ("3," if i % 2 else "") + ROW.format(i, i))
    (d / "none.csv").write_text("")
    df = files.recognizer_results(spark, [str(p) for p in sorted(d.iterdir())])
    assert sorted((r.audio_file_id, r.segment_number, r.order) for r in df.collect()) == [("c0", 0, None), ("c1", 1, 3), ("c2", 2, None), ("c3", 3, 3)]


def test_topics_command(spark, tmp_path, monkeypatch):
    """Transcripts to the coherence of each number of topics, stop words left out."""
    from vocalith.operators import topics

    words = ["calm", "call", "nurse", "night", "work", "sleep", "the"]
    for c in range(12):
        (tmp_path / "t" / f"c{c}").mkdir(parents=True)
        for h in ("one", "two"):
            (tmp_path / "t" / f"c{c}" / f"{h}.txt").write_text("".join(f"a_b_{i}_{i + 1} " + " ".join(words[(c + i + j) % 7] for j in range(5)) + "\n" for i in range(4)))
    (tmp_path / "stop.txt").write_text("the\n")
    sweep, trimmed = topics.sweep, topics.trim_vocabulary
    monkeypatch.setattr(topics, "sweep", lambda bag, texts: sweep(bag, range(2, 4), 2, texts))
    monkeypatch.setattr(topics, "trim_vocabulary", lambda bag: trimmed(bag, most_share=1.0))
    cli.main(["topics", "-t", str(tmp_path / "t"), "-o", str(tmp_path), "-w", "5", "-s", str(tmp_path / "stop.txt")])
    rows = spark.read.option("header", True).csv(f"{tmp_path}/topic_coherence").collect()
    assert sorted(r.k for r in rows) == ["2", "3"] and all(0 <= float(r.c_v) <= 1 for r in rows)
