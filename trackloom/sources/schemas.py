"""Schemas of the entities; fixed at ingest, so that everything after is typed."""

from __future__ import annotations

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
VIDEO = "video_id string, fps double, total_frames bigint, frame_width int, frame_height int, duration_seconds double"
MOTION_FRAME = "video_id string, frame_index bigint, timestamp_seconds double, motion_score double"
DETECTION = f"video_id string, frame_index bigint, class_id int, class_name string, confidence double, bounding_box {BOX}"
OBSERVATION = f"video_id string, track_id bigint, class_id int, class_name string, track_pos bigint, obs_pos bigint, frame_index bigint, timestamp_seconds double, confidence double, bbox {BOX}"
#: An observation as files have it, with the keys that different writers use.
LOOSE_OBSERVATION = (
    "struct<frame_index:bigint,frame_id:bigint,frame_number:bigint,frame:bigint,timestamp_seconds:double,timestamp:double,time_seconds:double,time:double,"
    f"confidence:double,bounding_box:{BOX},bbox:array<double>,box:array<double>,xyxy:array<double>>"
)
TRACK_FILE = (
    "video struct<video_name:string,fps:double,total_frames:bigint,frame_width:int,frame_height:int>, tracks map<string,struct<track_id:bigint,class_id:int,class_name:string,"
    f"observations:array<{LOOSE_OBSERVATION}>,track_history:array<{LOOSE_OBSERVATION}>,detections:array<{LOOSE_OBSERVATION}>,frames:array<{LOOSE_OBSERVATION}>>>"
)
DOCUMENT = "document_id string, text string, document string, description string, event_text string, metadata map<string,string>"
DOCUMENT_FILE = f"documents array<struct<{DOCUMENT.replace(' map', ':map').replace(' string', ':string').replace(', ', ',')}>>"
VLM = "colors map<string,string>, attributes array<string>, action string, orientation string, visibility string, confidence map<string,double>"
EVENT_INDEX = (
    "document_id string, event_id string, event_type string, document string, class_names array<string>, track_ids array<bigint>, "
    "start_time_seconds double, end_time_seconds double, duration_seconds double, quality_score double, embedding array<float>"
)
#: The relational tables, with their unique keys.
RELATIONAL = {
    "videos": ("id bigint, video_id string, filename string, duration double", "video_id"),
    "tracks": ("id bigint, track_id string, video_id string, object_type string, start_frame int, end_frame int", "track_id"),
    "objects": ("id bigint, object_id string, track_id string, label string, confidence double, color string, attributes string", "object_id"),
    "events": ("id bigint, event_id string, track_id string, action string, start_time double, end_time double, description string", "event_id"),
    "embeddings": ("id bigint, embedding_id string, track_id string, image_path string, rank int", "embedding_id"),
}
