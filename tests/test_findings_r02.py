"""What the findings of round 2 were about."""

import duckdb
from pyspark.sql import functions as F

from trackloom.operators import blocks, colors, pairs, quality
from trackloom.plans import catalogue, ingest, supplement
from trackloom.sources import testdata as D


def test_upserted_records_of_types_replace_no_part(spark, tmp_path):
    keys = [50, 51, 1000049, 1000050, 1000051]
    spark.createDataFrame([(k, f"name {k}", f"brand {k}", f"type {k}") for k in keys], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.index_upsert(spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(catalogue.ORACLE_SQL["index_upsert"]).fetchall())
    assert [x for x in got if x[0] == 1000050] == [(1000050, "brand 1000050"), (1000050, "type 50")]


def test_colour_shares_are_exact_where_four_places_end_in_a_half(spark):
    # 13 green pixels of weight 1.2 among 64.0 in all: 0.24375, in doubles 0.24374999999999994 by this order
    groups = {"green": (13, 60, 200, 200), "blue": (11, 100, 200, 200), "gray": (11, 0, 20, 100), "purple": (6, 150, 200, 200), "black": (13, 0, 0, 10), "pink": (4, 165, 200, 200), "white": (4, 0, 20, 220), "orange": (1, 15, 200, 200), "red": (1, 5, 200, 200), "yellow": (1, 30, 200, 200)}
    rows = [(1, h, s, v) for n, h, s, v in groups.values() for _ in range(n)]
    for part in (rows, rows[::-1], rows[::2] + rows[1::2]):
        got = colors.pixel_votes(spark.createDataFrame(part, "track_id long, h int, s int, v int").coalesce(1), ["track_id"], least=20).first()
        assert (got.primary_color, got.secondary_color, got.confidence) == ("unknown", "blue", 0.2438)


def test_scores_of_the_registered_queries_are_sums_of_points(spark):
    base = "event_id string, event_type string, duration_seconds double, reliability_status string, colour_attributes map<string,string>, motion_state string, motion_direction string, start_region struct<c:string>, end_region struct<c:string>, shared_frames long, near_ratio double, overlap_ratio double, relationship_types array<string>"
    rows = spark.createDataFrame([("a", "relationship_event", 1.0, None, None, None, None, None, None, 8, 0.9, 0.6, ["near", "overlapping", "moving_together"])], base)
    assert quality.judge(quality.score(rows)).first().quality_score == 1.0
    assert quality.judge(quality.score(rows, most=None)).first().quality_score == 1.02
    assert catalogue.ingest(spark, "/root/testdata/sf0.001").most_score is None


def test_pairs_by_blocks_are_those_of_the_joins(spark, sf):
    i = catalogue.ingest(spark, sf, videos=2)
    obs, moved = i.get("usable"), i.get("motion")
    twice = obs.unionByName(obs.where("track_id % 3 = 0").selectExpr(*[f"{c} + 7 AS {c}" if c in ("x1", "x2", "obs_pos") else c for c in obs.columns]))  # some tracks stand twice in a frame
    values = lambda df: sorted(tuple(map(str, r)) for r in df.drop("first_timestamp", "last_timestamp").collect())
    for rows in (obs, twice):
        want = values(pairs.relationships(pairs.pair_rows(rows, D.WIDTH, D.HEIGHT), moved))
        for block in (100, blocks.BLOCK):
            assert values(blocks.deal(rows, moved, D.WIDTH, D.HEIGHT, block=block).relationships()) == want != []


def test_counted_pairs_are_those_of_the_rows_and_leave_tasks_by_kind(spark, sf, monkeypatch):
    i = catalogue.ingest(spark, sf)
    kinds = ["track_a_class", "track_b_class", "relationship_types", "shared_frames", "near_ratio", "overlap_ratio"]
    want = sorted(map(str, i.get("relationships").groupBy(*kinds).count().collect()))
    monkeypatch.setattr(blocks, "TILE", 16)
    dealt = blocks.deal(i.get("usable"), i.get("motion"), D.WIDTH, D.HEIGHT, block=300)
    found = dealt.tallies()
    assert sorted(map(str, found.groupBy(*kinds).agg(F.sum("n").alias("count")).collect())) == want != []
    assert dict(pairs.counts(found).collect()) == dict(pairs.counts(i.get("tallies")).collect())
    assert "more" not in dealt._groups(blocks.TALLIES)._jdf.queryExecution().executedPlan().toString()  # only what counts need is sent


def test_numbers_of_events_in_crowded_videos(spark, sf, monkeypatch):
    want = sorted(map(tuple, catalogue.composite_events(spark, sf).collect()))
    monkeypatch.setattr(catalogue, "_INGESTS", {})
    monkeypatch.setattr(ingest.Ingest, "CROWDED", 0)
    monkeypatch.setattr(blocks, "TILE", 5)
    made = catalogue.ingest(spark, sf)
    monkeypatch.setitem(made.made, "blocks", blocks.deal(made.get("usable"), made.get("motion"), D.WIDTH, D.HEIGHT, block=100))
    assert sorted(map(tuple, catalogue.composite_events(spark, sf).collect())) == want
    assert made.get("crowded") and not [f for f in made.get("composite_events").inputFiles() if "/relationships-" in f or "/composite_events-" in f]


def test_document_files_of_crowded_videos_have_no_row_of_all_documents(spark, sf, monkeypatch):
    want = sorted(map(tuple, supplement.document_files(spark, sf).collect()))
    monkeypatch.setattr(catalogue, "_INGESTS", {})
    monkeypatch.setattr(ingest.Ingest, "CROWDED", 0)
    seen, written = [], supplement._written
    monkeypatch.setattr(supplement, "_written", lambda spark, rows, form, **options: seen.append(rows.select(F.max(F.size("documents"))).first()[0]) or written(spark, rows, form, **options))
    assert sorted(map(tuple, supplement.document_files(spark, sf).collect())) == want != []
    assert seen == [1]
