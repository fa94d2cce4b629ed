import pandas as pd
import pytest

from trackloom.sources import sinks  # noqa: F401
from trackloom.streaming import tracks


def test_sessions(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:05:00", "2024-01-01 01:00:00"]), "track_id": [1, 1, 1, 2], "class_name": "car", "frame_index": [0, 10, 300, 3600], "confidence": [0.5, 0.7, 0.9, 1.0]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = tracks.track_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("sessions").where("track_id = 1").orderBy("start").collect()
    assert [(r.observation_count, r.first_frame, r.last_frame) for r in got] == [(2, 0, 10), (1, 300, 300)]


def test_sampler_keeps_its_state(spark, tmp_path):
    schema = "video_id string, frame_index long, timestamp_seconds double, motion_score double"
    frames = [("v", i, i * 0.1, 1.0) for i in range(25)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracks.sample_stream(stream).writeStream.outputMode("append").format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "cp")).start()
    for part in (frames[:8], frames[8:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert sorted(r.frame_index for r in spark.table("sampled").collect()) == [0, 10, 20]


def test_upserts(spark, tmp_path):
    write = tracks.upsert_batches(str(tmp_path / "t"), "k")
    for epoch, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b")], [(3, "c")])):
        write(spark.createDataFrame(rows, "k int, v string"), epoch)
    assert sorted(map(tuple, tracks.latest(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    write(spark.createDataFrame([(3, "d")], "k int, v string"), 2)  # an epoch that comes again
    assert sorted(map(tuple, tracks.latest(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert tracks.versions(spark, str(tmp_path / "t")) == [1, 2]
    for f in (tmp_path / "t" / "2").glob("*.parquet"):  # a table that can't be read isn't an empty one
        f.write_bytes(b"none")
    with pytest.raises(Exception):
        write(spark.createDataFrame([(4, "e")], "k int, v string"), 3)
