import json

from vocalith.operators import dewey
from vocalith.plans.quality import QUERIES


def doc():
    word = {"Word": "a", "Offset": 1, "Phones": [None, {"Ph": "X"}, 5]}
    return {
        "result": {
            "audio_file_id": " c1 ",
            "channels": [
                None,
                {"segments": {"segment_number": "7", "nbest": [{"text": "t", "word_timing": [word, None, {"Word": None, "Phones": {"Ph": "Y"}}]}, {"word_timing": "[{'Word': 'it\\'s', 'Phones': None}]"}, {"word_timing": "broken ["}]}},
                {"segments": None},
                {"segments": [{"nbest": {"word_timing": {"Word": "solo"}}}, {}]},
            ],
        }
    }


def write(tmp_path, spark, payloads):
    d = tmp_path / "sf"
    spark.createDataFrame(payloads, "payload_id bigint, payload string, audio_file_id string").write.mode("overwrite").parquet(str(d / "result_payloads.parquet"))
    rec = [(1, " x ", 4, "[{'Word': 'w', 'Offset': 1, 'Duration': 2, 'Phones': [{'Ph': 'A'}, None]}]"), (2, None, None, "[{'Word': 'w', 'Offset': 1, 'Duration': 2}]"), (3, "y", 1, "[{}]"), (4, "y", 1, None)]
    spark.createDataFrame(rec, "result_id bigint, audio_file_id string, segment_number bigint, word_timing string").write.mode("overwrite").parquet(str(d / "recognition_results.parquet"))
    return str(d)


def test_found(spark, tmp_path):
    sf = write(tmp_path, spark, [(9, json.dumps(doc()), "clash"), (10, None, ""), (11, "{broken", ""), (12, json.dumps({"segments": [{"segment_number": 2, "nbest": [{"word_timing": [{"Word": "b"}]}]}]}), ""), (13, "[]", "")])
    got = sorted(tuple(r)[:8] for r in QUERIES["p3_found"](spark, sf).collect())
    want = [
        ("recognition_results", 1, "X", 0, 4, 0, 0, -1), ("recognition_results", 1, "X", 0, 4, 0, 0, 0), ("recognition_results", 2, "", 0, -1, 0, 0, -1),
        ("result_payloads", 9, "C1", 1, 7, 0, 0, -1), ("result_payloads", 9, "C1", 1, 7, 0, 0, 1), ("result_payloads", 9, "C1", 1, 7, 0, 2, -1), ("result_payloads", 9, "C1", 1, 7, 0, 2, 0), ("result_payloads", 9, "C1", 1, 7, 1, 0, -1),
        ("result_payloads", 9, "C1", 3, -1, 0, 0, -1), ("result_payloads", 12, "", 0, 2, 0, 0, -1),
    ]
    assert got == sorted(want)


def test_labels_and_parents(spark):
    df = spark.createDataFrame([(9, json.dumps(doc()))], "payload_id bigint, payload string")
    nodes = dewey.payload_nodes(df).withColumn("up", dewey.parent_label()).collect()
    labels = {tuple(r.label) for r in nodes}
    assert len(labels) == len(nodes)
    assert all(r.path == "record" or tuple(r.up) in labels for r in nodes)
    depth = {"record": 0, "channel": 1, "segment": 2, "alternative": 3, "word": 4, "phone": 5}
    assert all(len(r.label) == depth[r.path] for r in nodes)


def test_empty(spark, tmp_path):
    assert dewey.payload_nodes(spark.createDataFrame([], "payload_id bigint, payload string")).count() == 0
