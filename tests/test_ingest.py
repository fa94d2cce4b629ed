import json

import pytest
from pyspark.sql import functions as F

from trackloom.operators import clips, datasets, metadata, pairs, quality, retrieval, sampling, tracks
from trackloom.plans import encoders, ingest, search
from trackloom.sources import readers, schemas, sinks
from trackloom.sources import testdata as D

VIDEO = {"duration_seconds": 48.0, "fps": 30.0, "total_frames": 1440}


def obs(spark, rows):
    """rows: track, class, track_pos, obs_pos, frame, x1, y1, x2, y2"""
    df = spark.createDataFrame(rows, "track_id long, class_name string, track_pos long, obs_pos long, frame_index long, x1 double, y1 double, x2 double, y2 double")
    return df.withColumn("timestamp_seconds", F.col("frame_index") / 10.0).withColumn("confidence", F.lit(0.9))


def test_motion_edges(spark):
    still = [(1, "car", 0, i, i, 100.0, 100.0, 200.0, 200.0) for i in range(3)]
    right = [(2, "car", 1, i, i, 100.0 + 100 * i, 100.0, 200.0 + 100 * i, 200.0) for i in range(4)]
    once = [(3, "car", 2, 0, 5, 0.0, 0.0, 10.0, 10.0)]
    boxless = [(4, "car", 3, 0, 1, None, None, None, None)]
    got = {r.track_id: r for r in tracks.motion(obs(spark, still + right + once + boxless), 1000, 1000, 10.0).collect()}
    assert got[1].motion_state == got[1].direction == "stationary"
    assert (got[2].motion_state, got[2].direction, got[2].motion_consistency) == ("moving", "left_to_right", 1.0)
    assert got[2].net_displacement_pixels == 300 and got[2].average_speed_pixels_per_second == 1000
    assert (got[3].motion_state, got[3].direction, got[3].trajectory_points) == ("insufficient_data", "unknown", 1)
    assert 4 not in got


def test_pairs_follow_the_order_of_the_file(spark):
    # Frame 9 comes before frame 3 in the file; each track twice in frame 3 isn't a pair of its own.
    rows = [(1, "pedestrian", 0, 0, 9, 0.0, 0.0, 10.0, 10.0), (1, "pedestrian", 0, 1, 3, 0.0, 0.0, 10.0, 10.0), (1, "pedestrian", 0, 2, 4, 0.0, 0.0, 10.0, 10.0)]
    rows += [(2, "car", 1, i, f, 5.0, 0.0, 15.0, 10.0) for i, f in enumerate((3, 4, 9))]
    p = pairs.pair_rows(obs(spark, rows), 1000, 1000)
    r = pairs.relationships(p).first()
    assert (r.track_a_id, r.track_b_id, r.shared_frames, r.first_frame, r.last_frame) == (1, 2, 3, 9, 4)
    assert r.relationship_types == ["near", "overlapping", "human_near_vehicle"]
    t = pairs.relationships(p, order="time").first()
    assert (t.first_frame, t.last_frame) == (3, 9)
    assert pairs.relationships(p, shared=4).count() == 0


def test_quality_and_documents(spark):
    base = "event_id string, event_type string, duration_seconds double, reliability_status string, colour_attributes map<string,string>, motion_state string, motion_direction string, start_region struct<c:string>, end_region struct<c:string>, shared_frames long, near_ratio double, overlap_ratio double, relationship_types array<string>"
    rows = [
        ("a", "track_semantic_event", 0.05, "reliable", {"object_color": "red"}, "moving", "unknown", ("x",), ("y",), None, None, None, None),
        ("b", "track_semantic_event", 0.2, "review", {}, "unknown", "unknown", None, None, None, None, None, None),
        ("c", "track_semantic_event", 1.0, "reliable", {"object_color": "red"}, "moving", "left_to_right", ("x",), ("y",), None, None, None, None),
        ("d", "relationship_event", 1.0, None, None, None, None, None, None, 3, 1.0, 1.0, ["near"]),
        ("e", "relationship_event", 1.0, None, None, None, None, None, None, 8, 0.8, 0.3, ["near", "human_near_vehicle"]),
        ("f", "strange", 9.0, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.event_id: r for r in quality.judge(quality.score(spark.createDataFrame(rows, base))).collect()}
    assert [got[k].rejection_reason for k in "abcdef"] == ["hard_reject", "below_quality_threshold", None, "hard_reject", None, "hard_reject"]
    assert got["c"].quality_score == 1.0 and got["e"].quality_score == pytest.approx(0.94) and got["f"].quality_score == 0
    text = lambda d, s, e: spark.range(1).select(quality.document_text(F.lit(d), F.lit(s).cast("double"), F.lit(e).cast("double"))).first()[0]
    assert text("A car.", 1.0, 2.5) == "A car. The event occurred from 1.00 seconds to 2.50 seconds."
    assert text(" A car ", None, 2.0) == "A car." and text("  ", 1.0, 2.0) is None


def test_sampler(spark):
    rows = [("v", i, i * 0.1, 1.0 if i < 15 else 20.0) for i in range(25)]
    got = sampling.sample(spark.createDataFrame(rows, "video_id string, frame_index long, timestamp_seconds double, motion_score double")).orderBy("sample_number").collect()
    assert [r.frame_index for r in got] == [0, 10, 15, 17, 19, 21, 23]
    assert got[0].image_name == "frame_000001_src_000000.jpg"


def test_pipeline_and_search(spark, sf, tmp_path):
    i = ingest.Ingest(D.observations(spark, sf), D.WIDTH, D.HEIGHT, D.FPS, D.colors(spark, sf))
    manifest = i.run(str(tmp_path))
    assert list(manifest["rows"]) == i.STAGES and all(manifest["rows"].values())
    enc = encoders.HashingEncoder()
    events = i.event_index(enc).cache()
    a = search.answer(events, enc, "vehicles after 3 seconds", VIDEO, k=3)
    assert a["match_found"] and a["result_count"] == 3 and [r["rank"] for r in a["results"]] == [1, 2, 3]
    assert all(r["event_type"] == "track_semantic_event" for r in a["results"])  # an object question
    assert a["results"][0]["evidence_clip"]["status"] == "generated"
    assert "vehicles" in search.console(a)
    none = search.answer(events, enc, "purple motorcycles in the first 1 seconds", VIDEO)
    assert not none["match_found"] and none["summary"].startswith("No matching events")
    both = search.answer_many(events, enc, ["vehicles", "  "], VIDEO)
    assert both[0]["success"] and not both[1]["success"]
    with pytest.raises(ValueError):
        search.search(events, enc, "cars", 0)
    with pytest.raises(RuntimeError, match="stage temporal_bounds failed"):
        ingest.Ingest(D.observations(spark, sf).drop("x1", "timestamp_seconds"), 1, 1, 1.0).run(str(tmp_path / "x"))
    t = spark.createDataFrame([(1, "car", "red", 0.0, 2.0)], "track_id long, object_type string, color string, start_time double, end_time double")
    agent = search.agent_answer(t, events, enc, "a red car")
    assert agent["results"] and "relevant event" in agent["response"]
    meta = spark.createDataFrame([("e1", ["car"], ["red"], [], [], "09:10", "09:20")], "event_id string, object_types array<string>, colors array<string>, actions array<string>, attributes array<string>, start_time string, end_time string")
    h = search.hybrid_answer(meta, events, enc, "red car")
    assert h["plan"]["strategy"] == "hybrid" and h["results"]


def test_readers(spark, tmp_path):
    box = {"x1": 0, "y1": 0, "x2": 10, "y2": 10}
    doc = {"video": {"video_name": "v", "fps": 10.0}, "tracks": {"7": {"class_id": 3, "class_name": "car", "observations": [{"frame_index": 2, "bounding_box": box, "confidence": 0.5}, {"frame": 1, "xyxy": [1, 2, 3, 4], "time": 0.1}]}}}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    got = readers.observations(readers.json_document(spark, str(tmp_path / "t.json"), schemas.TRACK_FILE)).orderBy("obs_pos").collect()
    assert [(r.track_id, r.frame_index, r.bbox.x2, r.timestamp_seconds) for r in got] == [(7, 2, 10.0, None), (7, 1, 3.0, 0.1)]
    assert readers.json_document(spark, str(tmp_path / "none.json"), "a string", optional=True).count() == 0
    answers = spark.createDataFrame([('x {"colors": {"u": "red"}, "action": "a"} y',), ('```json\n{"colors": {"u": "red"}, "attributes": ["a",],}\n```',), ("nothing",), (None,)], "response string")
    assert [r.metadata is not None for r in readers.vlm_rows(answers).collect()] == [True, True, False, False]
    bad = spark.createDataFrame([("v", 0.0, 1, 1, 1)], "video_id string, fps double, total_frames long, frame_width int, frame_height int")
    with pytest.raises(Exception, match="unusable video"):
        readers.videos(bad).collect()
    (tmp_path / "crops" / "track_7").mkdir(parents=True)
    (tmp_path / "crops" / "track_7" / "rank_2.jpg").write_bytes(b"x")
    assert [(r.track_folder, r.image_name) for r in readers.crop_images(spark, str(tmp_path / "crops")).collect()] == [("track_7", "rank_2.jpg")]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "document_id string, v int")
    assert sorted(map(tuple, sinks.upsert(t, new, order="v").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    path = str(tmp_path / "t")
    t.write.parquet(path)
    assert sinks.insert_if_absent(new, spark, path, "document_id") == 1
    assert spark.read.parquet(path).count() == 3
    d = json.loads(sinks.as_document(t, "rows", n=F.count("*")).first().document)
    assert d["summary"]["n"] == 2 and len(d["rows"]) == 2


def test_track_metadata(spark):
    rows = [(1, 0, "car", "a", {"c": "red"}, ["x"], 0.5, 1.0, 4.0), (1, 1, "bus", "b", {"c": "blue"}, ["y", "x"], None, 3.0, 8.0), (1, 2, "bus", "a", {}, [], 1.0, None, None), (1, 3, "car", "b", {}, [], 0.5, None, None)]
    df = spark.createDataFrame(rows, "track_id long, position long, object string, action string, colors map<string,string>, attributes array<string>, confidence double, start_time double, end_time double")
    r = metadata.aggregate(df.withColumn("orientation", F.lit(None).cast("string")).withColumn("visibility", F.lit("full")).withColumn("duration", F.lit(1.0))).first()
    assert (r.object, r.action, r.orientation, r.visibility) == ("car", "a", None, "full")  # ties to the first seen
    assert (r.colors, r.attributes, r.confidence) == ({"c": "blue"}, ["x", "y"], 0.5)
    assert (r.start_time, r.end_time, r.duration, r.start_timestamp) == (1.0, 8.0, 7.0, "00:00:01.000")


def test_clips_and_merges(spark):
    r = spark.createDataFrame([("e", -1.0, 1.5), ("f", 45.0, 47.9)], "event_id string, start_time_seconds double, end_time_seconds double")
    got = [tuple(x) for x in clips.windows(r, 48.0, 30.0, 1440).select("clip_start", "clip_end", "start_frame", "end_frame", "frames_written", "filename").collect()]
    assert got == [(0.0, 3.5, 0, 105, 106, "e_0.000_to_3.500.mp4"), (43.0, 48.0, 1290, 1439, 150, "f_43.000_to_48.000.mp4")]
    a = spark.createDataFrame([("1", 0), (None, 1)], "id string, position int")
    b = spark.createDataFrame([("2", 0), ("1", 1)], "id string, position int")
    assert [(x.id, x.score) for x in retrieval.fuse_ranks([(a, "id", "sql_"), (b, "id", "vec_")]).collect()] == [("1", 0.0163), ("2", 0.0082), ("sql_1", 0.0081)]


def test_datasets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,0,10,20,30,40,1,4,0,0\n1,0,0,0,0,40,1,4,0,0\n2,0,10,20,30,40,1,11,0,0\n")
    boxes = datasets.convert(readers.annotations(spark, str(tmp_path / "a.txt")), {4: 3}, 100, 200)
    assert [tuple(r) for r in boxes.collect()] == [(1, 3, 0.25, 0.2, 0.3, 0.2)]
    assert datasets.label_files(boxes).first().label == "3 0.250000 0.200000 0.300000 0.200000"


def random_tracks(seed=2, tracks_=14, frames=25):
    """Boxes of very different sizes on random walks, some twice in a frame, some without a box."""
    import numpy as np

    rng, rows, n = np.random.default_rng(seed), [], 0
    for t in range(tracks_):
        x, y, size = rng.uniform(0, 900), rng.uniform(0, 900), float(rng.choice([5, 60, 500]))
        for f in sorted(rng.choice(frames, 15).tolist()):
            x, y, n = x + rng.uniform(-40, 40), y + rng.uniform(-40, 40), n + 1
            box = (x, y, x + size, y + size / 2) if rng.random() > 0.05 else (None, None, None, None)
            rows.append((t, "car" if t % 2 else "pedestrian", t, n, int(f), *box))
    return rows


def test_pairs_are_those_of_all_pairs(spark):
    rows, diag = random_tracks(), (1000**2 + 1000**2) ** 0.5
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[4] != b[4] or a[0] == b[0] or a[5] is None or b[5] is None:
                continue
            d = (((a[5] + a[7]) - (b[5] + b[7])) ** 2 + ((a[6] + a[8]) - (b[6] + b[8])) ** 2) ** 0.5 / 2 / diag
            over = min(a[7], b[7]) > max(a[5], b[5]) and min(a[8], b[8]) > max(a[6], b[6])
            want.setdefault((min(a[0], b[0]), max(a[0], b[0])), []).append((d, over))
    want = {k: (len(v), sum(d <= 0.08 for d, _ in v), sum(o for _, o in v)) for k, v in want.items() if len(v) >= 3}
    want = {k: v for k, v in want.items() if 2 * v[1] >= v[0] or 10 * v[2] >= 3 * v[0]}
    got = pairs.relationships(pairs.pair_rows(obs(spark, rows), 1000, 1000))
    assert {(r.track_a_id, r.track_b_id): (r.shared_frames, r.near_frames, r.overlap_frames) for r in got.collect()} == want and len(want) > 5


def test_videos_with_the_same_track_numbers(spark):
    one = obs(spark, random_tracks())
    both = one.withColumn("video_id", F.lit("a")).unionByName(one.withColumn("video_id", F.lit("b")))
    i, j = (ingest.Ingest(x, 1000, 1000, 10.0) for x in (one, both))
    for name in ("temporal_bounds", "representative_crops", "track_reliability", "motion", "spatial", "relationships"):
        alone = sorted(map(str, i.get(name).drop("video_id").collect()))
        for v in "ab":
            assert sorted(map(str, j.get(name).where(f"video_id = '{v}'").drop("video_id").collect())) == alone, name
    assert j.get("documents").count() == 2 * i.get("documents").count() > 0
    ids = [r.event_id for r in j.get("composite_events").collect()]
    assert len(set(ids)) == len(ids) == 2 * i.get("composite_events").count()


def test_positions_of_any_group(spark):
    from trackloom.operators.events import positions

    rows = [(g, (i * 7919) % 1000) for g, n in (("a", 700), ("b", 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r.g, r.v): r.position for r in positions(df, [F.col("v")], ["g"]).collect()}
    for g in ("a", "b", None):
        assert [got[g, v] for v in sorted(v for h, v in rows if h == g)] == list(range(1, sum(h == g for h, _ in rows) + 1))
    every = [r.position for r in positions(df, [F.col("v").desc(), F.col("g").asc_nulls_last()]).orderBy(F.col("v").desc(), F.col("g").asc_nulls_last()).collect()]
    assert every == list(range(1, len(rows) + 1))


def test_very_late_rows_keep_their_order(spark):
    far = 3 * 10**9  # beyond 2^31
    rows = [(1, "car", far, far, 9, 0.0, 0.0, 10.0, 10.0), (1, "car", far, far + 1, 3, 0.0, 0.0, 10.0, 10.0), (1, "car", far, far + 2, 4, 0.0, 0.0, 10.0, 10.0)]
    rows += [(2, "car", far + 5, far + 9 + k, f, 1.0, 0.0, 11.0, 10.0) for k, f in enumerate((3, 4, 9))]
    r = pairs.relationships(pairs.pair_rows(obs(spark, rows), 1000, 1000)).first()
    assert (r.first_frame, r.last_frame) == (9, 4)


def test_insert_if_absent_counts_what_it_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(path)
    new = spark.range(5).select(F.col("id").alias("k"))
    assert sinks.insert_if_absent(new, spark, path, "k") == 3 and sinks.insert_if_absent(new, spark, path, "k") == 0
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_one_document_for_each_video(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "video_id string, track_id long")
    got = {r.video_id: json.loads(r.document) for r in sinks.as_document(df, n=F.count("*")).collect()}
    assert got["a"]["summary"]["n"] == 2 and got["b"]["tracks"] == [{"track_id": 3}]
    fused = metadata.fuse(df, df, df, df).orderBy("video_id").collect()
    assert [len(r.tracks) for r in fused] == [2, 1]


def test_run_folders_and_the_five_products(spark, tmp_path):
    folder = ingest.run_folder(spark, str(tmp_path), "/videos/My Test-video.mp4")
    assert folder.endswith("/production_runs/my_test_video")
    i = ingest.Ingest(obs(spark, random_tracks()), 1000, 1000, 10.0)
    i.run(folder)
    assert (tmp_path / "production_runs" / "my_test_video" / "documents").exists()
    ingest.run_folder(spark, str(tmp_path), "My Test-video.mp4", clean=False)
    assert (tmp_path / "production_runs" / "my_test_video").exists()
    ingest.run_folder(spark, str(tmp_path), "My Test-video.mp4")
    assert not (tmp_path / "production_runs" / "my_test_video").exists()
    rows = [(1, 0, "car", "walking", {"body": "navy"}, ["bag"], 0.5, 1.0, 4.0), (1, 1, "car", "walking", {"body": "red"}, ["hat"], 0.7, 3.0, 8.0), (2, 0, "bus", None, {}, [], 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "track_id long, position long, object string, action string, colors map<string,string>, attributes array<string>, confidence double, start_time double, end_time double")
    df = df.withColumn("orientation", F.lit("front")).withColumn("visibility", F.lit("full")).withColumn("duration", F.lit(1.0))
    out = metadata.export(df, str(tmp_path / "products"))
    assert {k: v.count() for k, v in out.items()} == {"object_metadata": 3, "track_metadata": 2, "event_metadata": 2, "semantic_metadata": 4, "statistics": 6}
    assert {r.event: r.track_ids for r in out["event_metadata"].collect()} == {"car_walking": [1], "bus_unknown": [2]}
    assert {(r.event, r.track_id) for r in metadata.event_members(out["track_metadata"]).collect()} == {("car_walking", 1), ("bus_unknown", 2)}
