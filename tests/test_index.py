import json

import pytest

from trackloom.operators import index, metadata, retrieval, tracks
from trackloom.plans import encoders
from trackloom.sources import readers, schemas, sinks


def test_records_and_flat_form(spark):
    d = spark.createDataFrame([("a", "text a", 1.0, 3.5, 0.9, [1, 2], ["car", None], ""), ("b", "text b", None, 2.0, None, [3], ["bus"], "moving")], "document_id string, text string, start_time_seconds double, end_time_seconds double, quality_score double, track_ids array<long>, class_names array<string>, motion_state string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "document_id string, embedding array<float>")
    r = {x.document_id: x for x in index.flat(index.records(d, v)).collect()}
    assert (r["a"].duration_seconds, r["a"].track_ids, r["a"].class_names, r["a"].motion_state) == (2.5, "1,2", "car", "unknown")
    assert (r["b"].start_time_seconds, r["b"].duration_seconds, r["b"].quality_score, r["b"].motion_state) == (-1.0, -1.0, 0.0, "moving")
    with pytest.raises(Exception, match="without text"):
        index.records(d.withColumn("text", d.motion_state), v).collect()


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [3.0, 0.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [x.vec_id for x in index.nearest(v.where("vec_id < 5"), [1.0, 0.0], 3, "vec_id").collect()] == [1, 4, 3]
    assert [x.vec_id for x in index.nearest(v, [1.0, 0.0], 2, "vec_id", metric="l2").collect()] == [1, 3]
    q = v.where("vec_id in (1, 2)").withColumnRenamed("vec_id", "query_id")
    got = index.nearest_for_all(v, q, 2, block=1).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.neighbor) for x in got] == [(1, 1), (1, 4), (2, 2), (2, 3)]
    assert index.nearest_for_all(v, q.limit(0), 2).count() == 0


def test_image_records(spark):
    images = spark.createDataFrame([("t1", "rank_2_a.jpg"), ("t1", "a.jpg"), ("t2", "rank_3.jpg")], "track_id string, image_name string")
    t = spark.createDataFrame([("t1", "car", "turning")], "track_id string, object_type string, action string")
    assert [(r.embedding_id, r.description) for r in index.image_records(images, t).orderBy("embedding_id").collect()] == [("t1_rank_1", "car turning"), ("t1_rank_2", "car turning"), ("t2_rank_3", "")]


def test_visual_verification(spark):
    d = spark.createDataFrame([(1, "a", "pedestrian", "people", 0.9), (1, "a", "pedestrian", "car", 0.99), (1, "b", "pedestrian", "people", 0.1), (1, "c", "pedestrian", None, None), (2, "d", "car", "bus", 0.9)], "track_id long, crop_id string, class_name string, detected_class string, confidence double")
    crops = tracks.verify_crops(d)
    assert {r.crop_id: (r.verified, r.reason) for r in crops.collect()} == {"a": (True, "class_match"), "b": (False, "low_confidence"), "c": (False, "no_detection"), "d": (False, "class_mismatch")}
    rated = spark.createDataFrame([(1, "reliable", 0.9), (2, "reliable", 0.9), (3, "review", 0.5)], "track_id long, status string, score double")
    got = {r.track_id: r for r in tracks.verify_tracks(crops, rated).collect()}
    assert [got[k].final_status for k in (1, 2, 3)] == ["review", "reject", "reject"]
    assert got[1].visual_score == pytest.approx(0.65 / 3 + 0.35 * 0.9, abs=1e-4)


def test_fusion_and_context(spark):
    t = spark.createDataFrame([(7, "car", 1.0, 2.0)], "track_id long, class_name string, start_time double, end_time double")
    one = metadata.fuse(t, t, t.limit(0), t).first()
    assert json.loads(one.tracks[0])["track_id"] == 7 and not one.objects
    v = spark.createDataFrame([("track_7",), ("track_x",)], "track_folder string")
    assert {r.track_folder: r.class_name for r in metadata.track_context(v, t).collect()} == {"track_7": "car", "track_x": None}


def test_tables_and_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"documents": [{"document_id": "1", "text": "", "description": "a car"}, {"document_id": "2", "event_text": "b"}]}))
    views = readers.catalog(spark, {"doc_files": (str(tmp_path / "d.json"), schemas.DOCUMENT_FILE), "nothing_here": (str(tmp_path / "x.json"), "a string")})
    assert [r.text for r in readers.retrieval_documents(views["doc_files"]).orderBy("document_id").collect()] == ["a car", "b"]
    assert spark.table("nothing_here").count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"documents": [{"document_id": "1"}]}))
    with pytest.raises(Exception, match="no text in 1"):
        readers.retrieval_documents(readers.json_document(spark, str(tmp_path / "e.json"), schemas.DOCUMENT_FILE)).collect()
    sinks.create_tables(spark)
    assert set(schemas.RELATIONAL) <= {t.name for t in spark.catalog.listTables()}
    sinks.reset(spark, "videos", "a int")
    assert spark.table("videos").columns == ["a"]
    assert sinks.peek(spark.range(5), 3).count() == 3
    with pytest.raises(Exception, match="dimensions"):
        readers.embeddings(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2).collect()


def test_filters_of_stores(spark):
    t = spark.createDataFrame([(1, "Person", "Red", None, "walking", ["Hat", "bag"], 0.5, 0.1), (2, "person", "blue", "red", "walking", ["hat"], 0.9, 0.1), (3, "car", "red", None, "x", [], 1.0, 1.0)], "track_id long, object_type string, upper_color string, lower_color string, action string, attributes array<string>, confidence double, quality_score double")
    assert [r.track_id for r in retrieval.track_filter(t, "person", "red").collect()] == [2, 1]
    assert [r.track_id for r in retrieval.track_filter(t, "person", attributes=["hat", "bag"], k=5).collect()] == [1]
    assert [r.track_id for r in retrieval.contains_filter(t.withColumn("color", t.upper_color), "per", "lu").collect()] == [2]


def test_encoder(spark):
    e = encoders.HashingEncoder(16)
    v = e.encode(["a red car", ""])
    assert v.shape == (2, 16) and abs((v[0] ** 2).sum() - 1) < 1e-6 and (v[1] == 0).all()
    got = spark.createDataFrame([("a red car",), (None,)], "t string").select(encoders.encode_column(e, "t").alias("v")).collect()
    assert got[0].v == pytest.approx(v[0].tolist()) and set(got[1].v) == {0.0}
    with pytest.raises(ValueError):
        encoders.encode_query(e, " ")
