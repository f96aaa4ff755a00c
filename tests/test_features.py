import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vocalith.functions import text as tx
from vocalith.functions.providers import Providers, lexicon
from vocalith.operators import features as ft
from vocalith.operators import graphs as gr
from vocalith.operators import segments as sg
from vocalith.operators import topics as tp
from vocalith.plans import pipeline
from vocalith.plans.reference import QUERIES


def seg(spark, rows):
    """(id, ord, text) -> segments; both transcripts are the text."""
    return spark.createDataFrame([(i, o, n, t, t) for n, (i, o, t) in enumerate(rows)], "id string, ord bigint, tie bigint, text string, text_basic string")


def one(df, **where):
    rows = [r.asDict() for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1
    return rows[0]


def test_verbosity(spark):
    df = spark.createDataFrame([("a", "a bb"), ("a", "ccccccc")], "id string, text string")
    r = one(ft.word_stats(df))
    assert (r["wc_mean"], r["wc_median"], r["wc_stdev"], r["wc_min"], r["wc_max"], r["total_count"]) == (1.5, 1.5, 0.5, 1, 2, 3)
    assert r["lw_count"] == pytest.approx(1 / 3) and r["word_len"] == pytest.approx(10 / 3)
    assert one(ft.syllable_stats(df))["syll_max"] == 1


def test_lexical_diversity(spark):
    r = one(ft.lexical_diversity(seg(spark, [("x", 1, "a b"), ("x", 2, "a c")])))
    assert r["MATTR_10"] == r["MATTR_25"] == r["MATTR_50"] == 0.75
    assert r["HS"] == pytest.approx(100 * math.log(4 / (1 - 2 / 3.00001)))
    r = one(ft.lexical_diversity(seg(spark, [("x", 1, "")])))
    assert r["MATTR_10"] == 1 and r["HS"] == pytest.approx(100 * math.log(1 / (1 - 1 / 1.00001)))


def test_mattr_against_windows(spark):
    rng = random.Random(1)
    texts = {f"g{k}": [rng.choice("abcdefgh") for _ in range(rng.choice((3, 10, 11, 60)))] for k in range(8)}
    rows = [(k, i, " ".join(ws[i : i + 4])) for k, ws in texts.items() for i in range(0, len(ws), 4)]
    got = {r.id: r for r in ft.mattr(ft.word_positions(seg(spark, rows))).collect()}
    for k, ws in texts.items():
        for size in ft.MATTR_WINDOWS:
            w = min(size, len(ws))
            want = statistics.mean(len(set(ws[i : i + w])) / w for i in range(len(ws) - w + 1))
            assert got[k][f"MATTR_{size}"] == pytest.approx(want)


def test_order_is_by_ord_then_tie(spark):
    rows = [("x", 5, f"w{i}") for i in range(200)]
    got = ft.word_positions(seg(spark, rows)).orderBy("j").collect()
    assert [r.w for r in got] == [f"w{i}" for i in range(200)]


def test_sentences_over_segments(spark):
    got = tx.joined_sentences(seg(spark, [("x", 1, "One two"), ("x", 2, "three. Four"), ("x", 3, ""), ("x", 4, "five! "), ("x", 5, None)])).orderBy("sent_no").collect()
    assert [r.text for r in got] == ["One two three.", "Four  five!", "nan"]


def test_ms_timing(spark):
    timing = "[{'Word': 'a', 'Offset': 2000000, 'Duration': 3000000}, {'Word': 'b', 'Offset': 5000000, 'Duration': 4000000}, {'Word': 'c', 'Offset': 10000000, 'Duration': 5000000}]"
    df = spark.createDataFrame([("x", 1_000_000, 20_000_000, timing), ("x", 0, 0, "[]"), ("y", 5, None, None), ("z", 5, 10_000_000, "broken")], "id string, offset bigint, duration bigint, word_timing string")
    m = ft.timing_measures(df)
    assert sorted(r.value * 1e-4 for r in m.where("kind = 'silences'").collect()) == pytest.approx([100, 100, 600])
    r = one(ft.timing_features(m, spark.createDataFrame([("x", 60.0)], "id string, duration_s double")), id="x")
    assert r["words_max"] == pytest.approx(500) and r["segments_max"] == pytest.approx(2) and r["wps_max"] == pytest.approx(1.5)
    assert r["segs_per_min"] == 2 and r["sil_duration"] == pytest.approx(0.8) and r["short_utt_count"] == 1
    z = one(ft.timing_features(m, spark.createDataFrame([("x", 60.0)], "id string, duration_s double")), id="z")
    assert z["total_duration"] == 0 and z["spk_ratio"] is None and z["words_mean"] is None and z["sil_duration"] == 0


def test_alignment(spark):
    lines = ["0 4 p q sil", "4 6 p q hi", "6 10 p q", "10 12 p q [noise]", "12 14 p q"]
    df = spark.createDataFrame([("c", "s", i, x) for i, x in enumerate(lines)] + [("c", "t", 0, "0 4 p q sil")], "id string, seg string, i int, line string")
    m = ft.alignment_measures(df)
    of = lambda k: sorted(r.value for r in m.where(F.col("kind") == k).collect())
    assert of("silences") == [100, 100] and of("words") == [150] and of("phones") == [50, 50, 100] and of("segments") == pytest.approx([0.35])
    assert of("wps") == pytest.approx([1 / 0.35]) and of("pps") == pytest.approx([3 / 0.35])


def test_pos(spark):
    tags = "PRP VBZ DT JJ NN WP$ CC IN TO MD CD EX PDT WDT WRB WP RP UH".split()
    df = spark.createDataFrame([("x", t) for t in tags], "id string, tag string")
    r = one(ft.pos_features(df, spark.createDataFrame([("x", 100), ("empty", 0)], "id string, n bigint")), id="x")
    want = {"NOUN": 3, "PNOUN": 2, "VERB": 1, "DET": 2, "ADJ": 1, "PSNOUN": 1, "CC": 1, "PREP": 2, "ADV": 2, "INT": 1}
    assert {k: round(r[k] * 100) for k in want} == want
    assert (r["v_ratio"], r["n_ratio"], r["sc_ratio"], r["adj_ratio"]) == (3, 0.75, 2, 1) and r["pn_ratio"] == pytest.approx(2 / 3)


def test_liwc(spark):
    lex = lexicon(spark, (("work*", "w"), ("workshop", "exact"), ("you know", "f"), ("a b c", "f"), ("a", "x"), ("*", "never")))
    df = spark.createDataFrame([("x", "workshop you know a b c a"), ("y", "zzz")], "id string, text string")
    r = one(ft.liwc(df, lex.where("pattern <> ''"), ["w", "exact", "f", "x"]), id="x")
    # the prefix takes the word and the pair and triple of words that it opens
    assert r["w_liwc"] == pytest.approx(3 / 7) and r["exact_liwc"] == 0 and r["f_liwc"] == pytest.approx(2 / 7) and r["x_liwc"] == pytest.approx(2 / 7)


def test_graph_examples(spark):
    s = seg(spark, [("g", 1, "a b a b"), ("g", 2, "c"), ("h", 1, "x x x"), ("e", 1, "")])
    e = gr.edges(gr.naive_tokens(s))
    c = {r.id: r for r in gr.graph_counts(e).join(gr.graph_connectivity(e), "id").join(gr.graph_loops(e), "id").collect()}
    g = c["g"]
    assert (g.num_nodes_naive, g.num_edges_naive, g.ave_degree_naive, g.num_p_edges_naive, g.l1_naive, g.lcc_naive, g.lsc_naive, g.di_naive, g.asp_naive, g.l2_naive) == (3, 3, 2, 1, 0, 2, 2, 1, 1, 2)
    assert g.d_naive == pytest.approx(2 / 9)
    h = c["h"]
    assert (h.num_nodes_naive, h.num_edges_naive, h.ave_degree_naive, h.num_p_edges_naive, h.l1_naive, h.d_naive, h.di_naive, h.asp_naive) == (1, 2, 4, 1, 2, 0, 0, 0)
    assert "e" not in c
    n = one(gr.graph_features(s), id="g")
    assert n["num_nodes_naive_norm"] == pytest.approx(3 / 8)


def test_connectivity_against_floyd():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(1, 9)
        edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(rng.randrange(0, 14))] + [(f"v{rng.randrange(n)}", None)]
        names = sorted({v for e in edges for v in e if v})
        inf = 10**6
        und = {(a, b): 0 if a == b else inf for a in names for b in names}
        out = dict(und)
        for a, b in edges:
            if b and a != b:
                und[a, b] = und[b, a] = 1
                out[a, b] = 1
        for d in (und, out):
            for k in names:
                for a in names:
                    for b in names:
                        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
        lcc = max(sum(und[a, b] < inf for b in names) for a in names)
        lsc = max(sum(out[a, b] < inf and out[b, a] < inf for b in names) for a in names)
        reach = [und[a, b] for a in names for b in names if a != b and und[a, b] < inf]
        got = gr.connectivity(edges)
        assert got[:3] == (lcc, lsc, max(reach, default=0)) and got[3] == pytest.approx(sum(reach) / len(reach) if reach else 0)


def test_levels(spark):
    rows = spark.createDataFrame([("c1", "f", 1, "t"), (" C1 ", "f", 2, "t"), ("c2", None, 1, "t"), (None, "f", 1, "t")], "audio_file_id string, feature_id string, segment_number bigint, text string")
    assert {r.id for r in sg.segments(rows).collect()} == {"f"}
    calls = sg.segments(rows, by_feature=False)
    meta = spark.createDataFrame([("C1", "S_1", "2021-01-02")], "call_id string, subject_id string, day string")
    assert {r.id for r in sg.with_level(calls, meta, "day").collect()} == {"S_1_2021-01-02"}
    assert sg.with_level(calls, meta, "call").count() == 2
    split = sg.split_day_id(spark.createDataFrame([("S_1_2021-01-02",)], "id string")).first()
    assert (split.subject_id, split.date) == ("S_1", "2021-01-02")
    with pytest.raises(ValueError, match="level"):
        sg.with_level(calls, meta, "year")
    with pytest.raises(ValueError, match="call_type"):
        sg.metadata(meta, "no such")
    with pytest.raises(ValueError, match="unknown"):
        pipeline.extract(calls, ("nothing",))
    flags = spark.createDataFrame([("t",), ("False",), ("maybe",), (None,)], "x string").select(sg.flag("x").alias("b")).collect()
    assert [r.b for r in flags] == [True, False, None, None]


def test_hypotheses_and_sounds(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, None), ("b", 1, 3.0)], "id string, hyp_no int, f double")
    assert {r.id: r.f for r in ft.hypothesis_mean(df, ["f"]).collect()} == {"a": 2.0, "b": None}
    r = one(ft.non_verbal(spark.createDataFrame([("a", " [noise] x [laughter] [laughter]"), ("a", None)], "id string, text string")))
    assert r["laughter"] == pytest.approx(2 / 5) and r["noise"] == pytest.approx(1 / 5) and r["unk"] == 0


def test_phrases(spark):
    rows = spark.createDataFrame([(i, "a b c a b".split()) for i in range(10)], "id int, ws array<string>")
    found = tp.phrases(rows, 0.1, 5)
    assert {(r.a, r.b): r.n_ab for r in found.collect()} == {("a", "b"): 20, ("b", "c"): 10, ("c", "a"): 10}
    only = found.where("a = 'a'")
    assert {tuple(r.ws) for r in tp.apply_phrases(rows, only).collect()} == {("a_b", "c", "a_b")}
    greedy = spark.createDataFrame([(1, ["a", "a", "a"]), (2, []), (3, ["a"])], "id int, ws array<string>")
    same = spark.createDataFrame([("a", "a")], "a string, b string")
    assert {r.id: r.ws for r in tp.apply_phrases(greedy, same).collect()} == {1: ["a_a", "a"], 2: [], 3: ["a"]}


def test_corpus(spark):
    rows = spark.createDataFrame([("x", ["[noise]", "the", "a"] * 30), ("y", ["[noise]"]), ("y", ["b"] * 10)], "id string, ws array<string>")
    got = tp.corpus(rows, ["the"]).collect()
    assert [(r.id, Counter(r.ws)) for r in got] == [("x", Counter({"a": 30}))]


def test_all_sets_on_empty_input(spark):
    empty = seg(spark, []).withColumn("confidence", F.lit(None).cast("double")).withColumn("offset", F.lit(0)).withColumn("duration", F.lit(0)).withColumn("word_timing", F.lit(None).cast("string"))
    for name, df in pipeline.extract(empty, tuple(pipeline.REGISTRY)).items():
        assert df.count() == 0, name


def test_lemma_and_tag_graphs(spark):
    row = one(pipeline.graph(seg(spark, [("g", 1, "i walked dogs")]), Providers()))
    assert row["num_nodes_lemma"] == 3 and row["num_edges_pos"] == 2


def test_queries_are_named():
    assert len(QUERIES) >= 40


def test_topic_sweep_is_whole(spark, monkeypatch):
    """The registered query trains every number of topics of the reference, with the operator's iterations."""
    trained = []
    monkeypatch.setattr(tp, "train_topics", lambda bag, k, iterations: trained.append((k, iterations)) or (None, []))
    monkeypatch.setattr(tp, "topic_words", lambda *_: None)
    monkeypatch.setattr(tp, "coherence", lambda *_: spark.createDataFrame([(0, 0.5)], "topic int, npmi double"))
    assert [r.k for r in QUERIES["topic_sweep"](spark, "/root/testdata/sf0.001").orderBy("k").collect()] == [2, 7, 12, 17, 22, 27, 32, 37]
    assert trained == [(k, 5) for k in range(2, 40, 5)]


def greedy(words, pairs):
    out, i = [], 0
    while i < len(words):
        if tuple(words[i : i + 2]) in pairs:
            out.append("_".join(words[i : i + 2]))
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def test_phrases_stay_with_their_rows(spark):
    """Rows moved between tasks, columns pruned, repeated rows, empty and null lists."""
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(200)] * 2 + [None]
    rows = spark.createDataFrame([(i, ws) for i, ws in enumerate(lists)], "id int, ws array<string>")
    found = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "c")], "a string, b string")
    pairs = {("a", "b"), ("b", "b"), ("c", "c")}
    got = {r.id: r.ws for r in tp.apply_phrases(rows.repartition(7), found).collect()}
    assert got == {i: ws if ws is None else greedy(ws, pairs) for i, ws in enumerate(lists)}
    only = tp.apply_phrases(rows.repartition(7), found).select("ws").collect()
    assert sorted(map(str, (r.ws for r in only))) == sorted(map(str, got.values()))


def test_means_of_scores_are_exact(spark):
    """However rows are spread; a plain sum of these eight is 0.82298749..."""
    from fractions import Fraction

    scores = [0.8445, 0.5972, 0.9493, 0.9001, 0.7103, 0.8812, 0.8513, 0.85]
    rows = spark.createDataFrame([("x", s) for s in scores], "id string, confidence double")
    mean = float(sum(map(Fraction, map(str, scores))) / len(scores))
    for n in (1, 3, 8):
        assert ft.confidence(rows.repartition(n), ["id"]).first().conf_mean == mean


def test_means_of_scores_are_rounded_once(spark):
    """The sum of forty scores divided in doubles is 0.83985749...; small and large means keep all digits, no values have none."""
    from fractions import Fraction

    from vocalith.functions.stats import describe5

    groups = {"tie": [0.84] * 39 + [0.8343], "small": [1e-10, 0.0, 0.0], "large": [9e16, 8e16, 1.5], "negative": [-0.84] * 39 + [-0.8343]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "id string, confidence double")
    got = {r.id: r.conf_mean for r in ft.confidence(rows, ["id"]).collect()}
    assert got == {k: float(sum(map(Fraction, map(str, vs))) / len(vs)) for k, vs in groups.items()}
    assert rows.groupBy("id").agg(*describe5(F.col("confidence"), "c", when=F.lit(False), exact=18)).where("c_mean is null").count() == len(groups)


def test_paths_in_batches_and_parts(spark, monkeypatch):
    """Walks in many small batches, and an id that is split over tasks, give what plain breadth-first search gives."""
    from collections import deque

    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    edge_list = [(rng.choice(words), rng.choice(words)) for _ in range(70)] + [("alone", None)]
    near = {}
    for a, b in edge_list:
        near.setdefault(a, set())
        if b is not None:
            near.setdefault(b, set())
            if a != b:
                near[a].add(b)
                near[b].add(a)
    total = reached = diameter = lcc = 0
    for s in near:
        far, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
        total, reached, diameter, lcc = total + sum(far.values()), reached + len(far) - 1, max(diameter, *far.values()), max(lcc, len(far))
    monkeypatch.setattr(gr, "SOURCES", 7)
    found = gr.connectivity(edge_list)
    assert (found[0], found[2]) == (lcc, diameter) and found[3] == pytest.approx(total / reached)
    e = spark.createDataFrame([("x", a, b) for a, b in edge_list] + [("y", "p", "q")], "id string, src string, dst string")
    for split in (5, 1000):
        rows = {r.id: tuple(r)[1:] for r in gr.graph_connectivity(e, "", split).collect()}
        assert rows["x"] == pytest.approx(found) and rows["y"] == (2, 1, 1, 1.0)


def test_running_sum_over_shards(spark, monkeypatch):
    """Distinct, repeated, null and structured orders; buckets and shards of a few rows."""
    monkeypatch.setattr(tx, "TIE_BUCKET", 3)
    monkeypatch.setattr(tx, "ORDER_SHARD", 4)
    rng = random.Random(3)
    rows = [(k, rng.choice((None, *range(-3, 40))), t, rng.randrange(5)) for k in ("a", None, "b") for t in range(60)]
    want, acc = {}, Counter()
    for k, o, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        want[k, t] = acc[k]
        acc[k] += v
    df = spark.createDataFrame(rows, "k string, ord bigint, tie bigint, v int")
    flat = {(r.k, r.tie): r.s for r in tx.running_sum(df, ["k"], "v", "s").collect()}
    assert {x: v for x, v in flat.items() if x[0] is not None} == {x: v for x, v in want.items() if x[0] is not None}
    inside = df.withColumn("ord", F.struct((F.col("ord") % 5).alias("day"), "ord")).where("k is not null")
    acc, want = Counter(), {}
    for k, o, t, v in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1] is not None, math.fmod(r[1] or 0, 5), r[1] or 0, r[2])):
        want[k, t] = acc[k]
        acc[k] += v
    assert {(r.k, r.tie): r.s for r in tx.running_sum(inside, ["k"], "v", "s").collect()} == want


def test_mattr_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ft, "POSITIONS", 64)
    rng = random.Random(9)
    ws = [rng.choice("abcdefgh") for _ in range(300)]
    positions = spark.createDataFrame([("x", j, w) for j, w in enumerate(ws)], "id string, j bigint, w string")
    row = ft.mattr(positions).first()
    for n in ft.MATTR_WINDOWS:
        assert row[f"MATTR_{n}"] == pytest.approx(statistics.mean(len(set(ws[i : i + n])) / n for i in range(len(ws) - n + 1)))


def test_windows_and_cv(spark):
    """Windows by brute force; words that keep one company have a higher coherence than words that never meet."""
    rng = random.Random(21)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 30))] for _ in range(60)] + [None, []]
    rows = spark.createDataFrame([(t,) for t in texts], "ws array<string>")
    words, size = ["a", "c", "g", "zz"], 6
    want, whole = Counter(), 0
    for t in texts:
        for i in range(max(1, len(t) - size + 1)) if t else ():
            whole += 1
            held = [k for k, w in enumerate(words) if w in t[i : i + size]]
            want.update((x, y) for x in held for y in held if x <= y)
    got = {(r.a, r.b): r.n for r in tp.window_counts(rows.repartition(5), words, size=size).collect()}
    assert got.pop((None, None)) == whole and got == dict(want)
    apart = spark.createDataFrame([(["m", "n"] * 3,)] * 20 + [(["x", "u"],), (["y", "v"],)] * 20, "ws array<string>")
    listed = spark.createDataFrame([(0, 0, "m", 1.0), (0, 1, "n", 1.0), (1, 0, "x", 1.0), (1, 1, "y", 1.0), (2, 0, "none", 1.0)], "topic int, rank int, word string, weight double")
    cv = {r.topic: r.c_v for r in tp.coherence_cv(listed, apart).collect()}
    assert cv[0] == pytest.approx(1.0) and cv[1] < 0.3 and cv[2] == 0.0
    assert {r.c_v for r in tp.coherence_cv(listed, apart.where("false")).collect()} == {0.0}


def test_describe_table_is_exact(spark):
    """Large and small groups, ties, nulls, NaN, groups of none and null keys, against Python."""
    from vocalith.functions.stats import describe5_table

    rng = random.Random(17)
    groups = {"big": [rng.gauss(0, 1) for _ in range(20_001)], "even": [rng.random() for _ in range(20_000)], "ties": [float(rng.choice((1, 2, 2, 3))) for _ in range(15_000)], "half": [0.0] * 6000 + [1.0] * 6000, "two": [1.0, 4.0], None: [5.0, 7.0, 9.0], "none": [None, float("nan")]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("two", None), ("big", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for small in (0, 10, 100_000):
        got = {r.k: r for r in describe5_table(df, ["k"], F.col("v"), "p", small).collect()}
        assert set(got) == set(groups) and tuple(got["none"])[1:] == (None,) * 5
        for k, vs in groups.items():
            if k != "none":
                assert (got[k].p_max, got[k].p_min, got[k].p_med) == (max(vs), min(vs), statistics.median(vs))
                assert got[k].p_mean == pytest.approx(statistics.mean(vs)) and got[k].p_std == pytest.approx(statistics.pstdev(vs))
    assert describe5_table(df.where("false"), ["k"], F.col("v"), "p").count() == 0


def test_loops_from_the_least_vertex(spark):
    """Hubs, ties of degrees, walks both ways round, against all triples."""
    rng = random.Random(19)
    e = Counter()
    for _ in range(160):
        a, b = rng.choice("abcdefgh"), rng.choice(("a", "a", *"abcdefgh"))
        e[a, b] += 1
    nodes = sorted({v for p in e for v in p})
    l2 = sum(e[a, b] * e[b, a] for a in nodes for b in nodes if a != b) / 2
    l3 = sum(e[a, b] * e[b, c] * e[c, a] for a in nodes for b in nodes for c in nodes if len({a, b, c}) == 3) / 3
    df = spark.createDataFrame([("x", a, b, m) for (a, b), m in e.items() if m] + [("y", "p", None, 2)], "id string, src string, dst string, mult bigint")
    assert {r.id: (r.l2, r.l3) for r in gr.graph_loops(df, "").collect()} == {"x": (l2, l3), "y": (0.0, 0.0)}


def test_windows_over_shards(spark, monkeypatch):
    """A text over many rows and shards has the windows of its joined words."""
    monkeypatch.setattr(tp, "CV_SHARD", 8)
    rng = random.Random(23)
    texts = {k: [[rng.choice("abcde") for _ in range(rng.randrange(0, 7))] for _ in range(n)] for k, n in (("x", 12), ("y", 1), ("z", 2), ("w", 5))}
    rows = spark.createDataFrame([(k, o, o, ws) for k, parts in texts.items() for o, ws in enumerate(parts)], "id string, ord bigint, tie bigint, ws array<string>")
    words, size = list("abc"), 5
    want, whole = Counter(), 0
    for parts in texts.values():
        t = [w for p in parts for w in p]
        for i in range(max(1, len(t) - size + 1)) if t else ():
            whole += 1
            held = [k for k, w in enumerate(words) if w in t[i : i + size]]
            want.update((p, q) for p in held for q in held if p <= q)
    got = {(r.a, r.b): r.n for r in tp.window_counts(tp.texts_in_shards(rows, size=size), words, size=size).collect()}
    assert got.pop((None, None)) == whole and got == dict(want)
