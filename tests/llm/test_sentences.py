import random
import re
import textwrap

import pytest

from vocalith.llm import sentences as st

STARTS = ("The caller", "A nurse", "Our model", "She", "They", "The trainee")
ENDS = ("paused", "laughed quietly", "lost two segments", "spoke faster", "asked again")


def corpus():
    rng = random.Random(7)
    lines = []
    for _ in range(400):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(5)
            a, b = rng.choice(STARTS), rng.choice(ENDS)
            out.append([f"{a} {b}.", f"{a} {b}!", f"Dr. Velmora saw approx. {rng.randrange(9)} calls.", f"“Who is it?” asked {a.lower()}.", f"Did {a.lower()} call no. {rng.randrange(9)} again?"][kind])
        lines.append(" ".join(out))
    return lines


@pytest.fixture(scope="module")
def model():
    from collections import defaultdict

    found = None
    for _ in range(2):
        tables = {s: defaultdict(lambda: [0.0, 0.0]) for s in ("left", "right", "follow")}
        for x in corpus():
            st.document_counts(x, found, tables["left"], tables["right"], tables["follow"])
        found = st.next_model({a: {k: tuple(v) for k, v in b.items()} for a, b in tables.items()}, found)
    return found


def split(text, model):
    return [text[a:b] for a, b in st.sentence_spans(text, model)]


CASES = [
    (["Dr. Velmora saw approx. 3 calls.", "The caller paused!"], " "),
    (["“Who is it?” asked the nurse.", "She paused."], " "),
    (["A nurse laughed quietly.", "Did they call no. 5 again?", "They paused."], " "),
    (["Session notes", "The caller paused.", "no marks here"], "\n"),
    (["A: The caller paused.", "B: She asked again!"], "\n"),
    (["1. Our model paused.", "2. Our model asked again."], "\n"),
    (["The caller paused.", "She paused."], ""),
]


@pytest.mark.parametrize(("parts", "glue"), CASES)
def test_split(parts, glue, model):
    assert split(glue.join(parts), model) == parts


def test_wrapped_lines_go_on(model):
    long = "The caller laughed quietly because the trainee and the nurse asked again about the long silence. She paused, and then the whole team spoke faster and faster until the very end of the long call."
    got = split(textwrap.fill(long, 66) + "\n\nThey paused.", model)
    assert [" ".join(x.split()) for x in got] == [*re.split(r"(?<=silence\.) ", long), "They paused."]


def test_thai():
    got = [(a, b) for a, b in st.sentence_spans("A: ผู้โทรพูดเบามาก พยาบาลถาม 5 ครั้ง “ได้ยินไหม” พยาบาลถาม", st.Model())]
    text = "A: ผู้โทรพูดเบามาก พยาบาลถาม 5 ครั้ง “ได้ยินไหม” พยาบาลถาม"
    assert [text[a:b] for a, b in got] == ["A: ผู้โทรพูดเบามาก", "พยาบาลถาม 5 ครั้ง", "“ได้ยินไหม” พยาบาลถาม"]


@pytest.mark.parametrize("parts", [["The caller paused.", "She said ได้ยิน and asked again.", "They paused."], ["It cost ฿5.", "The caller paused!", "She paused."], ["She said ได้ยิน.", "They paused."]])
def test_thai_word_in_another_script(parts, model):
    assert split(" ".join(parts), model) == parts


@pytest.mark.parametrize("text", [None, "", " \n\t ", "...", "\"", "«", ")(", "a" * 30_000, "A. " * 5000, "。" * 3000, "“" * 2000, "x.\n" * 3000, "ก ข " * 2000])
def test_covers_everything(text, model):
    spans = st.sentence_spans(text, model)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    held = set().union(*(range(a, b) for a, b in spans)) if spans else set()
    assert all(c.isspace() for i, c in enumerate(text or "") if i not in held)


def test_forward_backward_is_exact(model):
    """Posteriors of a chain equal those of adding up all its labellings."""
    import itertools
    import math

    rng = random.Random(2)
    chain = [(rng.uniform(-3, 0), rng.uniform(-3, 0)) for _ in range(6)]
    got = model._chain(chain)
    weight = {}
    for events in itertools.product((0, 1), repeat=len(chain)):
        w = sum(chain[i][e] for i, e in enumerate(events)) + sum(model.follow[a][b] for a, b in zip(events, events[1:]))
        weight[events] = math.exp(w)
    total = sum(weight.values())
    for i, p in enumerate(got):
        assert p == pytest.approx(sum(w for e, w in weight.items() if e[i]) / total)


def test_on_spark(spark):
    rows = [(i, x, "clash") for i, x in enumerate(corpus())] + [(9000, None, ""), (9001, " ", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sent_start string")
    model = st.train(docs)
    got = {(r.doc_id, r.sent_start, r.sent_end) for r in st.split_sentences(docs, model).collect()}
    want = {(i, a, b) for i, x, _ in rows for a, b in st.sentence_spans(x, model)}
    assert got == want
    truth = sum(1 + (x.count(". ") + x.count("! ") + x.count("? ") - x.count("Dr. ") - x.count("approx. ") - x.count("no. ")) for _, x, _ in rows[:400])
    assert abs(len(got) - truth) <= 0.02 * truth
    empty = docs.where("false")
    assert st.split_sentences(empty, st.train(empty)).count() == 0


def test_mixed_scripts_in_one_block():
    from collections import defaultdict

    found = None
    texts = corpus() + ["Hello there.", "Next one here.", "And more.", "This is fine."] * 20
    for _ in range(2):
        tables = {s: defaultdict(lambda: [0.0, 0.0]) for s in ("left", "right", "follow")}
        for x in texts:
            st.document_counts(x, found, tables["left"], tables["right"], tables["follow"])
        found = st.next_model(tables, found)
    assert split("Hello there. This is ภาษา word. Next one here. And more.", found) == ["Hello there.", "This is ภาษา word.", "Next one here.", "And more."]


def test_thai_blanks_are_decided_by_the_model():
    """A blank whose words stand at no end and no start of a line is none, though nothing but the model speaks against it."""
    from collections import defaultdict

    found = None
    lines = ["ผู้โทรพูด พยาบาลถาม", "พยาบาลถาม ผู้โทรพูด", "ผู้โทรพูด", "พยาบาลถาม", "ผู้โทรพูด คืกคัก นานมาก", "พยาบาลถาม คืกคัก นานมาก"] * 30
    for _ in range(2):
        tables = {s: defaultdict(lambda: [0.0, 0.0]) for s in ("left", "right", "follow")}
        for x in lines:
            st.document_counts(x, found, tables["left"], tables["right"], tables["follow"])
        found = st.next_model(tables, found)
    assert split("ผู้โทรพูด พยาบาลถาม คืกคัก นานมาก", found) == ["ผู้โทรพูด", "พยาบาลถาม", "คืกคัก นานมาก"]


def test_no_caps(model):
    """Long words, long speaker names, narrow and wide pages."""
    name = "Doctor " + "Velmora-" * 20 + "Quillane"
    assert split(f"{name}: The caller paused. She asked again.", model) == [f"{name}: The caller paused.", "She asked again."]
    word = "pa" * 400
    assert split(f"The caller {word}. She paused.", model) == [f"The caller {word}.", "She paused."]
    long = "The caller laughed quietly because the trainee and the nurse asked again about the long silence in the middle of the call. She paused, and then the whole team spoke faster and faster until the very end of the long call, which nobody had expected on that day."
    for width in (30, 240):
        text = textwrap.fill(" ".join([long] * (1 if width == 30 else 8)), width)
        got = [" ".join(x.split()) for x in split(text, model)]
        assert got == re.split(r"(?<=call\.) ", long) * (1 if width == 30 else 8)


def test_both_ways_of_reading_agree():
    """Phrases and single words give the same events."""
    import numpy as np

    texts = [x for x in corpus()[:60]] + ["1. Dr. J. K. Velmora (e.g. app. B) said: “Stop. Now.” z.B. «Oui !» dit-il. ¿Sí?La 3.5 won't. A: “No.”", "- one two. - three"]
    a, b = st.read(texts), st.read([*texts, "ก ข"])
    for name in ("block", "end", "next", "left", "left_shape", "script", "right", "right_shape", "context", "gap", "inside", "quoted"):
        x, y = getattr(a, name), getattr(b, name)
        assert np.array_equal(x, y[: len(x)]), name


def test_buckets_keep_every_type(spark):
    """The distributed fold is the one in memory, and crowded buckets lose no counts."""
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(corpus())], "doc_id bigint, text string")
    counted = st.expected_counts(st.events_of(docs), None)
    for buckets in (64, 1 << 14):
        folded = st.fold(counted, buckets).toPandas()
        hashed = folded[folded["side"] == st.PAIR]
        whole = counted.where(f"side <= {st.PAIR}").toPandas()[["no", "yes"]].sum()
        for row in (0, 1):
            own = hashed[hashed["row"] == row][["no", "yes"]].sum()
            assert abs(own - whole).max() < 1e-6
        h = counted.where(f"side <= {st.PAIR}").toPandas()["key"].to_numpy().view("uint64")
        assert set(hashed[hashed["row"] == 0]["key"]) == set(st._slots(h, buckets)[0]) and set(hashed[hashed["row"] == 1]["key"]) == set(st._slots(h, buckets)[1])


def test_packed_events_are_the_same():
    import dataclasses

    import numpy as np

    for texts in ([], ["x"], corpus(), ["“One. Two.” he said. A: ‘No. Yes.’", "ก ข. “ค” ง"]):
        e = st.read(texts)
        ids, base = np.arange(len(texts)) + 2**40, st._bases(texts)
        got, i, b = st.unpack(st.pack(e, ids, base))
        assert np.array_equal(i, ids) and np.array_equal(b, base)
        for f in dataclasses.fields(e):
            x, y = getattr(e, f.name), getattr(got, f.name)
            flat = lambda z: [z] if isinstance(z, np.ndarray) else [v for w in z for v in flat(w)]
            assert all(np.array_equal(p, q) for p, q in zip(flat(x), flat(y), strict=True)), f.name


def test_null_and_large_numbers(spark):
    """Documents without number, with the same one, with very large ones; nulls beside them."""
    rows = [(None, "She paused. They paused."), (2**62 + 1, "One."), (5, "Two."), (5, "Two."), (6, None), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.sent_end) for r in st.split_sentences(docs, st.train(docs)).collect())
    assert [x for x in got if x[0] != "None"] == [(str(2**62 + 1), 4), ("5", 4), ("5", 4)] and {x[0] for x in got if x not in got[:3]} == {"None"}


def test_lines_that_run_on(model):
    """After a comma a small letter goes on; unpunctuated lines of like lengths stand alone; blanks that don't break are no breaks."""
    assert split("The caller paused,\nand she asked again.\nThey paused.", model) == ["The caller paused,\nand she asked again.", "They paused."]
    lines = ["i can't remember the date", "the heating's off again by myself", "work was slow today two weeks ago", "work was slow today last night at", "right my brother's car broke down", "so i can't remember the date"]
    assert split("\n".join(lines), model) == lines
    assert split("1286. The caller paused.\n1287. She asked again.", model) == ["1286. The caller paused.", "1287. She asked again."]
