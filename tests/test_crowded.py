"""Crowded videos: what queries over numbered events run, and what they leave on disk."""

import time

import numpy as np
import pytest

from trackloom.operators import blocks, events
from trackloom.plans import catalogue, ingest, staging, supplement


@pytest.fixture
def crowded(spark, sf, monkeypatch):
    monkeypatch.setattr(catalogue, "_INGESTS", {})
    monkeypatch.setattr(ingest.Ingest, "CROWDED", 0)
    return catalogue.ingest(spark, sf)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["search_nearest", "search_limited", "search_orchestrated", "clip_selection"])
def test_searches_keep_the_nearest_and_sort_no_documents(spark, sf, crowded, name):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert "rangepartitioning" not in text and "TakeOrderedAndProject" in text and text.count("FlatMapGroupsInArrow") == 1


def test_pairs_are_counted_once_for_the_numbers(spark, sf, crowded, monkeypatch):
    dealt, seen = events.positions, []
    monkeypatch.setattr(events, "positions", lambda df, *a, **b: seen.append((b.get("name"), plan(df))) or dealt(df, *a, **b))
    crowded.get("composite_events")
    numbers = [text for name, text in seen if name == "event_number" and "Union" in text]
    assert numbers and not any("FlatMapGroupsInArrow" in text for text in numbers)


def test_clip_statistics_needs_no_numbers(spark, sf, crowded, monkeypatch):
    monkeypatch.setattr(blocks.Blocks, "counts", lambda self: pytest.fail("pairs were counted"))
    got = supplement.clip_statistics(spark, sf).collect()
    monkeypatch.undo()
    monkeypatch.setattr(catalogue, "_INGESTS", {})
    assert got == supplement.clip_statistics(spark, sf).collect()


def test_kinds_of_pairs_are_no_expression_that_filters_repeat(spark, sf, crowded):
    assert "lambdafunction" not in plan(catalogue.clip_windows(spark, sf))


def test_rows_of_crowded_videos_are_those_of_others(spark, sf, crowded, monkeypatch):
    names = ["quality_rejects", "result_rows", "clip_windows", "search_limited", "pair_relationships"]
    got = {n: sorted(map(str, catalogue.QUERIES[n](spark, sf).collect())) for n in names}
    monkeypatch.undo()
    monkeypatch.setattr(catalogue, "_INGESTS", {})
    assert got == {n: sorted(map(str, catalogue.QUERIES[n](spark, sf).collect())) for n in names}


def test_squeezed_columns_come_back_by_the_bit():
    r = np.random.default_rng(0)
    for n in (1, 7, 1000):
        whole = [r.integers(-(2**63), 2**63 - 1, n), np.arange(n), np.array([2**63 - 1, -(2**63)] * n)[:n]]
        real = [r.normal(size=n), np.round(r.normal(size=n) * 1e3), np.array([0.0, -0.0, np.nan, np.inf] * n)[:n], np.arange(n) % 3 / 30.0, np.array([2.0**53, -(2.0**60)] * n)[:n]]
        a, b = blocks._open([blocks._squeeze(whole, real)] * 2, len(whole), len(real))
        assert all((np.r_[x, x].view(np.int64) == y.view(np.int64)).all() for x, y in zip([*whole, *real], [*a, *b], strict=True))
    frames = np.sort(r.integers(0, 1440, 10_000))
    assert len(blocks._squeeze([frames], [np.floor(r.random(10_000) * 3) + frames, frames / 30.0])) < 2.5 * 10_000


def test_staged_products_leave_no_shuffle_behind(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before, had = files(), spark.conf.get(staging.FREED, None)
    staging.staged(spark.range(1000).repartition(4, "id"), "few")
    for _ in range(50):  # they go a little later
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(staging.FREED, None) == had
