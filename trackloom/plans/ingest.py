"""Ingest: tracked observations to retrieval documents, one plan for each product."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import text as T
from trackloom.operators import blocks, events, quality, tracks
from trackloom.plans import encoders, staging


def run_folder(spark: SparkSession, root: str, video: str, clean: bool = True) -> str:
    """The folder of a run over a video, root/production_runs/<name of the file>; a run before it
    is removed if clean."""
    name = video.rstrip("/").rpartition("/")[2].rpartition(".")[0] or video
    slug = spark.range(1).select(T.slug(F.lit(name))).first()[0]
    folder = f"{root.rstrip('/')}/production_runs/{slug}"
    if clean and staging.exists(spark, folder):
        staging.delete(spark, folder)
    return folder


@dataclass
class Ingest:
    """The products of observations; each is planned when it is first asked for. Products of a
    row per track, pair or event that several others use are written once they are asked for
    (staged), so that no plan scans the observations more often than it must. The products of a
    row per pair are not where there are many observations: in a crowded video pairs may be far
    more than the input, and each use compares the tracks anew, block by block."""

    observations: DataFrame
    width: int
    height: int
    fps: float
    colors: DataFrame | None = None
    include_review: bool = True
    most_score: float | None = 1.0  # see quality.score
    staged: bool = True
    made: dict[str, DataFrame] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    STAGED = ("temporal_bounds", "track_reliability", "motion", "relationships", "atomic_events", "composite_events", "documents")
    #: Staged for up to so many observations.
    OF_PAIRS, CROWDED = ("relationships", "composite_events", "documents"), 1 << 20
    STAGES = ["temporal_bounds", "representative_crops", "track_reliability", "motion", "spatial", "relationships", "atomic_events", "composite_events", "quality", "documents"]

    def get(self, name: str) -> DataFrame:
        if name not in self.made:
            made = getattr(self, name)()
            keep = self.staged and name in self.STAGED and not (name in self.OF_PAIRS and self.get("crowded"))
            self.made[name] = staging.staged(made, name) if keep else made
        return self.made[name]

    def crowded(self) -> bool:
        return self.staged and self.observations.count() > self.CROWDED

    def temporal_bounds(self) -> DataFrame:
        return tracks.temporal_bounds(self.observations, self.fps)

    def representative_crops(self) -> DataFrame:
        return tracks.best_crops(self.observations, self.width, self.height)

    def track_reliability(self) -> DataFrame:
        return tracks.reliability(self.get("temporal_bounds"), self.get("representative_crops"))

    def usable(self) -> DataFrame:
        return tracks.usable(self.observations, self.get("track_reliability"), self.include_review)

    def motion(self) -> DataFrame:
        return tracks.motion(self.get("usable"), self.width, self.height, self.fps)

    def spatial(self) -> DataFrame:
        return tracks.spatial(self.get("motion"), self.width, self.height)

    def relationships(self) -> DataFrame:
        return self.get("blocks").relationships()

    def blocks(self) -> blocks.Blocks:
        return blocks.deal(self.get("usable"), self.get("motion"), self.width, self.height)

    def atomic_events(self) -> DataFrame:
        return events.atomic(self.get("temporal_bounds"), self.get("track_reliability"), self.colors, self.include_review)

    def of_tracks(self) -> DataFrame:
        return events.of_tracks(self.get("atomic_events"), self.get("motion"), self.get("spatial"))

    def tallies(self) -> DataFrame:
        """Relationships for counts of them: a row stands for n pairs."""
        return self.get("blocks").tallies() if self.get("crowded") else self.get("relationships").withColumn("n", F.lit(1).cast("bigint"))

    def event_rows(self) -> DataFrame:
        """Composite events for counts of them: without numbers, a row stands for n events."""
        of_tracks = self.get("of_tracks")
        return of_tracks.withColumn("n", F.lit(1).cast("bigint")).unionByName(events.of_pairs(self.get("tallies"), of_tracks, "n"))

    def composite_events(self) -> DataFrame:
        if not self.get("crowded"):
            return events.composite(self.get("atomic_events"), self.get("motion"), self.get("spatial"), self.get("relationships"))
        # Numbers of pairs follow from how many each track has in each block, so pairs needn't be dealt by ranges.
        some, of_tracks = self.get("blocks"), self.get("of_tracks")
        # Dealing out by ranges runs its input more than once, so the counts are written first.
        counts = staging.staged(some.counts(), "counts").select("video_id", F.lit(1).alias("part"), F.lit(0.0).alias("o1"), F.col("track_a_id").alias("o2"), F.col("j").alias("o3"), "at", "n")
        both = of_tracks.withColumn("n", F.lit(1).cast("bigint")).unionByName(counts, allowMissingColumns=True)
        placed = staging.staged(events.positions(both, [F.col(c) for c in events.ORDER], name="event_number", weight="n"), "placed")
        before = placed.where("part = 1").select("video_id", "at", F.col("o3").alias("j"), (F.col("event_number") - F.col("n")).alias("before"))
        of_pairs = events.of_pairs(some.relationships(before), of_tracks, F.col("number").alias("event_number"))
        rows = placed.where("part = 0").drop("at", "n").unionByName(of_pairs)
        return rows.withColumn("event_id", F.format_string("composite_event_%06d", "event_number")).drop(*events.ORDER[1:])

    def unnumbered(self) -> DataFrame:
        """Composite events for what doesn't ask for their numbers."""
        if not self.get("crowded"):
            return self.get("composite_events")
        of_tracks = self.get("of_tracks")
        return of_tracks.unionByName(events.of_pairs(self.get("relationships"), of_tracks))

    def quality(self) -> DataFrame:
        return quality.judge(quality.score(self.get("composite_events"), self.include_review, most=self.most_score))

    def judged_rows(self) -> DataFrame:
        """Judged events without their numbers, for counts of them."""
        return quality.judge(quality.score(self.get("event_rows"), self.include_review, most=self.most_score))

    def documents(self) -> DataFrame:
        return quality.documents(self.get("quality"))

    def event_index(self, encoder: encoders.Encoder) -> DataFrame:
        """Documents as index records with vectors."""
        d = self.get("documents").withColumn("embedding", encoders.encode_column(encoder, F.col("text")))
        return d.withColumn("document", F.col("text")).withColumn("duration_seconds", F.round(F.col("end_time_seconds") - F.col("start_time_seconds"), 4))

    def run(self, folder: str) -> dict:
        """Write every product below folder, in order, each read again by the next ones; the
        name of the stage that fails is in the error. Returns the manifest."""
        spark, self.staged, counts = self.observations.sparkSession, False, {}
        for name in self.STAGES:
            began = time.time()
            try:
                path = f"{folder}/{name}"
                self.get(name).write.mode("overwrite").parquet(path)
                self.made[name] = spark.read.parquet(path)
                counts[name] = self.made[name].count()
            except Exception as e:
                raise RuntimeError(f"stage {name} failed: {e}") from e
            self.timings[name] = round(time.time() - began, 4)
        manifest = {"stages": self.STAGES, "stage_timings_seconds": self.timings, "total_seconds": round(sum(self.timings.values()), 4), "rows": counts, "outputs": {n: f"{folder}/{n}" for n in self.STAGES}}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        return manifest
