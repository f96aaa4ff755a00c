from vocalith.operators.features import timing_measures
from vocalith.operators.segments import segments
from vocalith.streaming import segments as st

TIMING = "[{'Word': 'a', 'Offset': 2, 'Duration': 3}]"


def rows(spark):
    made = [(i, f"c{i % 3}", i, "t", 0, 10, TIMING if i % 4 else "broken", f"2021-01-0{1 + i % 2} 00:00:00") for i in range(20)]
    return spark.createDataFrame(made, "result_id bigint, audio_file_id string, segment_number bigint, text string, offset bigint, duration bigint, word_timing string, received_at string").selectExpr("* except (received_at)", "cast(received_at as timestamp) received_at")


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    batch = rows(spark)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = st.results_stream(spark, str(tmp_path / "in"), batch.schema, 1)
    got = run(st.measures_stream(stream), "measures", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, timing_measures(segments(batch, by_feature=False)).collect()))
    report = run(st.rejects_stream(stream), "rejects", "complete")
    assert sorted((str(r.day.start)[:10], r.word_reason, r.n_rows) for r in report.collect()) == [("2021-01-01", "quoting", 5)]
