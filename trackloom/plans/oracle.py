"""The SQL twins of the catalogue: one chain of common table expressions, from which each
query takes what it needs."""

from __future__ import annotations

from trackloom.functions import vocabulary as V
from trackloom.sources.testdata import COLORS_SQL, OBS_SQL, obs_sql

DIAG = "sqrt(1920.0 * 1920.0 + 1080.0 * 1080.0)"


def region(axis: str, size: float, names: tuple) -> str:
    return f"CASE WHEN {axis} / {size} < 1.0/3.0 THEN '{names[0]}' WHEN {axis} / {size} < 2.0/3.0 THEN '{names[1]}' ELSE '{names[2]}' END"


def h(x: str) -> str:
    return region(x, 1920.0, ("left", "center", "right"))


def v(y: str) -> str:
    return region(y, 1080.0, ("top", "middle", "bottom"))


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


CHAIN = f"""
{OBS_SQL}, {COLORS_SQL},
geo AS (
  SELECT *, least(1920, CAST(trunc(x2) AS INTEGER)) - greatest(0, CAST(trunc(x1) AS INTEGER)) AS crop_width, least(1080, CAST(trunc(y2) AS INTEGER)) - greatest(0, CAST(trunc(y1) AS INTEGER)) AS crop_height,
    {h("cx")} || '_' || {v("cy")} AS region
  FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM obs)
),
bounds AS (
  SELECT video_id, track_id, min(class_name) AS class_name, min(track_pos) AS track_pos, count(*) AS observation_count, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
    round(min(timestamp_seconds), 4) AS start_time, round(max(timestamp_seconds), 4) AS end_time, round(greatest(0.0, max(timestamp_seconds) - min(timestamp_seconds)), 4) AS duration
  FROM obs GROUP BY video_id, track_id
),
crops AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY final_score DESC, obs_pos) AS rank FROM (
    SELECT *, 0.40 * confidence + 0.25 * 0.0 + 0.20 * size_score + 0.15 * center_score AS final_score FROM (
      SELECT *, least(crop_width * crop_height / CAST(0.20 * 2073600 AS DOUBLE), 1.0) AS size_score,
        1 - least(sqrt(((cx - 960.0) / 960.0) * ((cx - 960.0) / 960.0) + ((cy - 540.0) / 540.0) * ((cy - 540.0) / 540.0)), 1.0) AS center_score
      FROM geo WHERE crop_width >= 40 AND crop_height >= 40))
  QUALIFY rank <= 3
),
rel0 AS (
  SELECT b.*, c.crop_count, greatest(0.0, least(1.0, observation_count / CASE WHEN class_name IN ('car','van','truck','bus') THEN 8.0::DOUBLE WHEN class_name = 'bicycle' THEN 6.0::DOUBLE ELSE 5.0::DOUBLE END)) AS p,
    greatest(0.0, least(1.0, 0.70 * mean_score + 0.30 * CASE WHEN crop_count = 1 THEN 0.55 ELSE greatest(0.0, least(1.0, 1 - spread)) END)) AS cc,
    greatest(0.0, least(1.0, mean_confidence)) AS d, greatest(0.0, least(1.0, crop_count / 3.0::DOUBLE)) AS n,
    CASE WHEN class_name = 'bicycle' AND observation_count < 4 THEN 0.20 ELSE 0.0 END + CASE WHEN class_name IN ('car','van','truck','bus') AND observation_count <= 2 THEN 0.18 ELSE 0.0 END
      + CASE WHEN class_name = 'people' AND observation_count <= 2 THEN 0.15 ELSE 0.0 END + CASE WHEN crop_count = 1 THEN 0.08 ELSE 0.0 END AS pen
  FROM bounds b JOIN (SELECT video_id, track_id, count(*) AS crop_count, avg(final_score) AS mean_score, max(final_score) - min(final_score) AS spread, avg(confidence) AS mean_confidence FROM crops GROUP BY video_id, track_id) c USING (video_id, track_id)
),
rel AS (
  SELECT *, CASE WHEN raw >= 0.65 THEN 'reliable' WHEN raw >= 0.40 THEN 'review' ELSE 'reject' END AS status, round(raw, 4) AS score,
    array_to_string(CASE WHEN len(why) = 0 THEN ['no_major_quality_issue'] ELSE why END, ',') AS reasons
  FROM (SELECT *, greatest(0.0, least(1.0, 0.35 * p + 0.30 * cc + 0.20 * d + 0.15 * n - CAST(pen AS DOUBLE))) AS raw,
    list_filter([CASE WHEN class_name = 'bicycle' AND observation_count < 4 THEN 'short_bicycle_track' END, CASE WHEN class_name IN ('car','van','truck','bus') AND observation_count <= 2 THEN 'very_short_vehicle_track' END,
      CASE WHEN class_name = 'people' AND observation_count <= 2 THEN 'short_group_track' END, CASE WHEN crop_count = 1 THEN 'single_representative_crop' END,
      CASE WHEN p < 0.30 THEN 'weak_temporal_persistence' END, CASE WHEN cc < 0.35 THEN 'weak_crop_quality' END, CASE WHEN d < 0.35 THEN 'low_detection_confidence' END], lambda x: x IS NOT NULL) AS why FROM rel0)
),
usable AS (SELECT o.*, r.status AS reliability_status, r.score AS reliability_score FROM obs o JOIN rel r USING (video_id, track_id) WHERE r.status IN ('reliable', 'review')),
steps AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS step FROM (
    SELECT video_id, track_id, class_name, frame_index, obs_pos, cx, cy, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy, frame_index - lag(frame_index) OVER w AS gap
    FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM usable) WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_index, obs_pos))
),
mot0 AS (
  SELECT *, ex - sx AS dx, ey - sy AS dy, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS net, (end_frame - start_frame) / 30.0::DOUBLE AS dur FROM (
    SELECT video_id, track_id, min(class_name) AS class_name, count(*) AS points, min(frame_index) AS start_frame, max(frame_index) AS end_frame,
      arg_min(cx, (frame_index, obs_pos)) AS sx, arg_min(cy, (frame_index, obs_pos)) AS sy, arg_max(cx, (frame_index, obs_pos)) AS ex, arg_max(cy, (frame_index, obs_pos)) AS ey,
      coalesce(sum(step) FILTER (WHERE gap > 0), 0.0) AS path, max(step / (gap / 30.0::DOUBLE)) FILTER (WHERE gap > 0) AS top_speed,
      avg(dx / step) FILTER (WHERE gap > 0 AND step > 1e-8) AS ux, avg(dy / step) FILTER (WHERE gap > 0 AND step > 1e-8) AS uy
    FROM steps GROUP BY video_id, track_id)
),
mot1 AS (
  SELECT *, CASE WHEN net / {DIAG} < 0.015 AND path / {DIAG} < 0.025 THEN 'stationary' WHEN path / {DIAG} < 0.06 THEN 'slow_moving' ELSE 'moving' END AS st,
    CASE WHEN net / {DIAG} < 0.015 THEN 'stationary' WHEN a < -157.5 OR a >= 157.5 THEN 'right_to_left' WHEN a < -112.5 THEN 'top_right_to_bottom_left' WHEN a < -67.5 THEN 'top_to_bottom'
      WHEN a < -22.5 THEN 'top_left_to_bottom_right' WHEN a < 22.5 THEN 'left_to_right' WHEN a < 67.5 THEN 'bottom_left_to_top_right' WHEN a < 112.5 THEN 'bottom_to_top' ELSE 'bottom_right_to_top_left' END AS di
  FROM (SELECT *, degrees(atan2(-dy, dx)) AS a FROM mot0)
),
motion AS (
  SELECT video_id, track_id, class_name, points AS trajectory_points, CASE WHEN points < 2 THEN 'insufficient_data' WHEN st = 'stationary' OR di = 'stationary' THEN 'stationary' ELSE st END AS motion_state,
    CASE WHEN points < 2 THEN 'unknown' WHEN st = 'stationary' OR di = 'stationary' THEN 'stationary' ELSE di END AS direction,
    CASE WHEN points >= 2 THEN round(sx, 2) END AS start_x, CASE WHEN points >= 2 THEN round(sy, 2) END AS start_y, CASE WHEN points >= 2 THEN round(ex, 2) END AS end_x, CASE WHEN points >= 2 THEN round(ey, 2) END AS end_y,
    CASE WHEN points >= 2 THEN round(dur, 4) END AS duration, CASE WHEN points >= 2 THEN round(net, 2) END AS net_displacement_pixels, CASE WHEN points >= 2 THEN round(path, 2) END AS path_distance_pixels,
    CASE WHEN points >= 2 THEN round(net / {DIAG}, 6) END AS normalized_displacement, CASE WHEN points >= 2 THEN round(CASE WHEN dur > 0 THEN path / dur ELSE 0.0 END, 2) END AS average_speed_pixels_per_second,
    CASE WHEN points >= 2 THEN round(coalesce(top_speed, 0.0), 2) END AS maximum_speed_pixels_per_second,
    CASE WHEN points >= 2 THEN round(CASE WHEN points >= 3 THEN greatest(0.0, least(1.0, coalesce(sqrt(ux * ux + uy * uy), 0.0))) ELSE 0.0 END, 4) END AS motion_consistency
  FROM mot1
),
place AS (
  SELECT *, CASE WHEN s = e THEN 'remained_in_' || s ELSE s || '_to_' || e END AS region_transition, CASE WHEN sh = eh THEN 'remained_' || sh ELSE sh || '_to_' || eh END AS horizontal_transition,
    CASE WHEN sv = ev THEN 'remained_' || sv ELSE sv || '_to_' || ev END AS vertical_transition,
    CASE WHEN s = e AND motion_state = 'stationary' THEN class_name || ' remained stationary in the ' || replace(s, '_', ' ') || ' region' WHEN s = e THEN class_name || ' remained within the ' || replace(s, '_', ' ') || ' region'
      ELSE class_name || ' moved from the ' || replace(s, '_', ' ') || ' region to the ' || replace(e, '_', ' ') || ' region' END AS description
  FROM (SELECT *, sh || '_' || sv AS s, eh || '_' || ev AS e FROM (SELECT *, {h("start_x")} AS sh, {v("start_y")} AS sv, {h("end_x")} AS eh, {v("end_y")} AS ev FROM motion WHERE trajectory_points >= 2))
),
framed AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, min(row(track_pos, obs_pos)) OVER (PARTITION BY video_id, frame_index) AS frame_rank FROM usable),
pair0 AS (
  SELECT a.video_id, least(a.track_id, b.track_id) AS track_a_id, greatest(a.track_id, b.track_id) AS track_b_id, CASE WHEN a.track_id > b.track_id THEN b.class_name ELSE a.class_name END AS track_a_class,
    CASE WHEN a.track_id > b.track_id THEN a.class_name ELSE b.class_name END AS track_b_class, a.frame_index, a.frame_rank, a.timestamp_seconds AS seconds,
    sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) / {DIAG} AS distance,
    greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab
  FROM framed a JOIN framed b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND row(a.track_pos, a.obs_pos) < row(b.track_pos, b.obs_pos) AND a.track_id <> b.track_id
),
pair1 AS (
  SELECT video_id, track_a_id, track_b_id, track_a_class, track_b_class, count(*) AS shared_frames, count(*) FILTER (WHERE distance <= 0.08) AS near_frames, count(*) FILTER (WHERE inter > 0) AS overlap_frames,
    avg(distance) AS average, least(1.0, min(distance)) AS least_d, max(CASE WHEN aa + ab - inter <= 0 THEN 0.0 ELSE inter / (aa + ab - inter) END) AS iou,
    arg_min(frame_index, frame_rank) AS first_frame, arg_max(frame_index, frame_rank) AS last_frame, arg_min(seconds, frame_rank) AS first_timestamp, arg_max(seconds, frame_rank) AS last_timestamp
  FROM pair0 GROUP BY ALL HAVING count(*) >= 3
),
related AS (
  SELECT * EXCLUDE (kinds), list_filter(kinds, lambda x: x IS NOT NULL) AS relationship_types FROM (
    SELECT p.*, near_frames / shared_frames AS nr, overlap_frames / shared_frames AS ovr, [CASE WHEN near_frames / shared_frames >= 0.50 THEN 'near' END, CASE WHEN overlap_frames / shared_frames >= 0.30 THEN 'overlapping' END,
      CASE WHEN near_frames / shared_frames >= 0.50 AND ((track_a_class IN ('pedestrian','people') AND track_b_class IN ('car','van','truck','bus','bicycle')) OR (track_b_class IN ('pedestrian','people') AND track_a_class IN ('car','van','truck','bus','bicycle'))) THEN 'human_near_vehicle' END,
      CASE WHEN ma.direction = mb.direction AND ma.direction NOT IN ('unknown', 'stationary') AND average <= 0.06 AND shared_frames >= 5 THEN 'moving_together' END] AS kinds
    FROM pair1 p LEFT JOIN motion ma ON ma.video_id = p.video_id AND ma.track_id = track_a_id LEFT JOIN motion mb ON mb.video_id = p.video_id AND mb.track_id = track_b_id)
  WHERE len(list_filter(kinds, lambda x: x IS NOT NULL)) > 0
),
who AS (
  SELECT b.*, r.status AS reliability_status, r.score AS reliability_score, object_color, upper_color, lower_color,
    CASE WHEN class_name IN ('pedestrian', 'people') THEN class_name || CASE WHEN upper_color <> 'unknown' AND lower_color <> 'unknown' THEN ' with ' || upper_color || ' upper clothing and ' || lower_color || ' lower clothing'
        WHEN upper_color <> 'unknown' THEN ' with ' || upper_color || ' upper clothing' WHEN lower_color <> 'unknown' THEN ' with ' || lower_color || ' lower clothing' ELSE '' END
      ELSE CASE WHEN object_color <> 'unknown' THEN object_color || ' ' ELSE '' END || class_name END AS subject
  FROM bounds b JOIN (SELECT video_id, track_id, status, score FROM rel WHERE status IN ('reliable', 'review')) r USING (video_id, track_id) LEFT JOIN colors USING (video_id, track_id)
),
atomic AS (
  SELECT *, row_number() OVER (ORDER BY video_id, track_pos, track_id, k) AS event_number, printf('event_%06d', row_number() OVER (ORDER BY video_id, track_pos, track_id, k)) AS event_id FROM (
    SELECT who.*, 0 AS k, 'object_observed' AS event_type, start_time AS s, end_time AS e, duration AS dd, NULL AS t, NULL AS f, printf('%s observed from %.2fs to %.2fs for %.2fs', subject, start_time, end_time, duration) AS event_text FROM who
    UNION ALL SELECT who.*, 1, 'object_entered', NULL, NULL, NULL, start_time, first_frame, printf('%s entered the scene at %.2fs', subject, start_time) FROM who
    UNION ALL SELECT who.*, 2, 'object_exited', NULL, NULL, NULL, end_time, last_frame, printf('%s exited the scene at %.2fs', subject, end_time) FROM who)
),
comp0 AS (
  SELECT a.video_id, 0 AS part, a.s AS o1, a.event_number AS o2, 0 AS o3, 'track_semantic_event' AS event_type, CAST(a.track_id AS VARCHAR) AS track_ids, a.class_name AS class_names, a.s AS start_time_seconds, a.e AS end_time_seconds, a.dd AS duration_seconds,
    a.reliability_status, (coalesce(a.object_color, 'unknown') <> 'unknown' OR coalesce(a.upper_color, 'unknown') <> 'unknown' OR coalesce(a.lower_color, 'unknown') <> 'unknown') AS coloured, p.motion_state, p.direction AS motion_direction, p.region_transition, NULL AS relationship_types, NULL AS shared_frames, NULL AS near_ratio, NULL AS overlap_ratio,
    CASE WHEN p.motion_state = 'stationary' THEN phrase || ' remained stationary in the ' || replace(p.s, '_', ' ') || ' region' WHEN p.s <> p.e THEN phrase || ' moved from the ' || replace(p.s, '_', ' ') || ' region to the ' || replace(p.e, '_', ' ') || ' region'
      WHEN p.direction NOT IN ('unknown', 'stationary') THEN phrase || ' moved ' || replace(p.direction, '_', ' ') || ' within the ' || replace(p.s, '_', ' ') || ' region' ELSE phrase || ' was observed in the ' || replace(p.s, '_', ' ') || ' region' END AS description
  FROM (SELECT *, CASE WHEN object_color <> 'unknown' THEN object_color || ' ' || class_name WHEN upper_color <> 'unknown' AND lower_color <> 'unknown' THEN class_name || ' wearing ' || upper_color || ' upper clothing and ' || lower_color || ' lower clothing'
      WHEN upper_color <> 'unknown' THEN class_name || ' wearing ' || upper_color || ' upper clothing' WHEN lower_color <> 'unknown' THEN class_name || ' wearing ' || lower_color || ' lower clothing' ELSE class_name END AS phrase
    FROM atomic WHERE event_type = 'object_observed') a JOIN place p USING (video_id, track_id)
  UNION ALL
  SELECT video_id, 1, 0.0, track_a_id, track_b_id, 'relationship_event', track_a_id || ',' || track_b_id, track_a_class || ',' || track_b_class, least(first_timestamp, last_timestamp), greatest(first_timestamp, last_timestamp), greatest(first_timestamp, last_timestamp) - least(first_timestamp, last_timestamp),
    NULL, false, NULL, NULL, NULL, relationship_types, shared_frames, round(nr, 4), round(ovr, 4),
    CASE WHEN list_contains(relationship_types, 'moving_together') THEN 'A ' || track_a_class || ' and a ' || track_b_class || ' moved together' WHEN list_contains(relationship_types, 'human_near_vehicle') THEN 'A person was near a ' || CASE WHEN track_b_class <> 'pedestrian' THEN track_b_class ELSE track_a_class END
      WHEN list_contains(relationship_types, 'overlapping') THEN 'A ' || track_a_class || ' and a ' || track_b_class || ' overlapped while visible together' ELSE 'A ' || track_a_class || ' and a ' || track_b_class || ' remained near each other' END
  FROM related
),
composite AS (SELECT *, printf('composite_event_%06d', row_number() OVER (ORDER BY video_id, part, o1, o2, o3)) AS event_id FROM comp0),
scored AS (
  SELECT *, CASE WHEN event_type = 'track_semantic_event' THEN duration_seconds < 0.10 ELSE shared_frames < 4 END AS hard_reject, round(CASE WHEN event_type = 'track_semantic_event' THEN
      CASE reliability_status WHEN 'reliable' THEN 0.40 WHEN 'review' THEN 0.22 ELSE 0 END + CASE WHEN duration_seconds >= 1 THEN 0.25 WHEN duration_seconds >= 0.5 THEN 0.20 WHEN duration_seconds >= 0.2 THEN 0.12 WHEN duration_seconds >= 0.1 THEN 0.06 ELSE 0 END
      + CASE WHEN coloured THEN 0.15 ELSE 0 END + 0.10 + 0.10
    ELSE CASE WHEN shared_frames >= 15 THEN 0.40 WHEN shared_frames >= 8 THEN 0.32 WHEN shared_frames >= 5 THEN 0.24 WHEN shared_frames >= 4 THEN 0.16 ELSE 0 END + CASE WHEN near_ratio >= 0.8 THEN 0.25 WHEN near_ratio >= 0.5 THEN 0.15 ELSE 0 END
      + CASE WHEN overlap_ratio >= 0.5 THEN 0.20 WHEN overlap_ratio >= 0.3 THEN 0.12 ELSE 0 END + CASE WHEN list_contains(relationship_types, 'moving_together') THEN 0.15 ELSE 0 END + CASE WHEN list_contains(relationship_types, 'human_near_vehicle') THEN 0.15 ELSE 0 END + 0.10 END::DOUBLE, 4) AS quality_score
  FROM composite
),
judged AS (
  SELECT *, NOT hard_reject AND quality_score >= 0.5 AS accepted, CASE WHEN quality_score >= 0.8 THEN 'high' WHEN quality_score >= 0.6 THEN 'medium' ELSE 'low' END AS quality_label,
    CASE WHEN hard_reject THEN 'hard_reject' WHEN quality_score < 0.5 THEN 'below_quality_threshold' END AS rejection_reason FROM scored
),
documents_of AS (SELECT *, event_id AS document_id, description || '.' || printf(' The event occurred from %.2f seconds to %.2f seconds.', start_time_seconds, end_time_seconds) AS text FROM judged WHERE accepted)
"""


def from_chain(select: str, videos: int = 1) -> str:
    return f"WITH {CHAIN.replace(OBS_SQL, obs_sql(videos))} {select}"


def matched(where: str, bonus: float, k: int = 10) -> str:
    """A search: the filters, the similarity to the asked vector, the score and the ranks."""
    double = "list_transform({}, lambda x: x::DOUBLE)"
    return from_chain(
        f"""SELECT event_id, similarity, hybrid_score, row_number() OVER w AS rank FROM (
        SELECT event_id, quality_score, distance, round(greatest(-1.0, least(1.0, 1 - distance)), 4) AS similarity, round(round(greatest(-1.0, least(1.0, 1 - distance)), 4) + 0.08 * quality_score + {bonus}, 4) AS hybrid_score
        FROM (SELECT d0.*, lower(text) AS d, 1 - list_cosine_similarity({double.format("e.embedding")}, {double.format("q.embedding")}) AS distance FROM documents_of d0
          JOIN embeddings e ON e.vec_id = CAST(split_part(document_id, '_', 3) AS BIGINT) * 37 % (SELECT count(*) FROM embeddings) JOIN embeddings q ON q.vec_id = 7) WHERE {where})
        WINDOW w AS (ORDER BY hybrid_score DESC, similarity DESC, quality_score DESC, distance, event_id) QUALIFY rank <= {k}"""
    )


CLASS_LIST = listed(V.CLASSES)
