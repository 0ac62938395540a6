"""Schemas of the tables, as Spark DDL. Keys marked below compare null as equal to null."""

from __future__ import annotations

POINT = "struct<x: double, y: double, z: double, confidence: double>"

TABLES: dict[str, str] = {
    "videos": "video_id string, video_url string, status string, team_id string, position string, download_path string, jersey_number string, player_number int, error string, notify_email string, "
    "frame_count int, jersey_source_frame int, jersey_confidence double, overall_grade double, letter_grade string, archived boolean, authenticity_signals map<string, boolean>, "
    "archived_at timestamp, claimed_at timestamp, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "video_stages": "video_id string, stage_name string, play_index int, status string, attempt int, started_at timestamp, completed_at timestamp, extra map<string, string>",
    "ingestion_queue": "id long, video_id string, stage string, status string, priority int, created_at timestamp, updated_at timestamp, processing_started_at timestamp, "
    "completed_at timestamp, failed_at timestamp, retry_count int, max_retries int, error string, metadata map<string, string>, play_index int",
    "frames": "video_id string, frame_index int, timestamp_seconds double, path string, width int, height int, play_index int",
    "pose": f"video_id string, frame_index int, track_id int, timestamp_seconds double, confidence_mean double, landmarks map<string, {POINT}>, play_index int, created_at timestamp",
    "torso_crops": "video_id string, frame_index int, track_id int, crop_path string, crop_box array<double>, play_index int, created_at timestamp",
    "reps": "video_id string, rep_index int, track_id int, play_index int, start_frame int, end_frame int, duration_frames int, duration_seconds double, jersey_number string",
    "rep_analysis": "video_id string, rep_index int, track_id int, play_index int, traits map<string, double>, buckets map<string, string>, overall_grade double",
    "camera_motion": "video_id string, frame_index int, homography_to_prev array<double>, homography_to_ref array<double>, translation_x double, translation_y double, rotation_deg double, "
    "scale double, inlier_ratio double, num_matches int, num_inliers int, low_confidence boolean",
    "whistle_events": "video_id string, event_index int, timestamp double, confidence double, onset_strength double, spectral_centroid double, duration double, type string",
    "detections": "video_id string, frame_index int, detection_index int, bbox array<double>, confidence double, class_name string, play_index int, created_at timestamp",
    "tracks": "video_id string, frame_index int, track_id int, bbox array<double>, mask_area_px double, confidence double, matched_via string, occlusion_state string, "
    "frames_since_last_seen int, play_index int, created_at timestamp",
    "tracks_meta": "video_id string, track_id int, play_index int, jersey_number string, role string, status string, jersey_confidence double, role_confidence double, "
    "jersey_source_frame int, first_frame int, last_frame int, total_frames_tracked int, track_id_conflict boolean",
    "plays": "video_id string, play_index int, start_frame int, end_frame int, status string, detection_method string, confidence double, clip_ready boolean, created_at timestamp",
}

# Natural keys, and those of their columns that may be null.
KEYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "videos": (("video_id",), ()),
    "video_stages": (("video_id", "stage_name"), ("play_index",)),
    "ingestion_queue": (("id",), ()),
    "frames": (("video_id", "frame_index"), ()),
    "pose": (("video_id", "frame_index"), ("track_id",)),
    "torso_crops": (("video_id", "frame_index"), ("track_id",)),
    "reps": (("video_id", "rep_index"), ("track_id", "play_index")),
    "rep_analysis": (("video_id", "rep_index"), ("track_id", "play_index")),
    "camera_motion": (("video_id", "frame_index"), ()),
    "whistle_events": (("video_id", "event_index"), ()),
    "detections": (("video_id", "frame_index", "detection_index"), ()),
    "tracks": (("video_id", "frame_index", "track_id"), ()),
    "tracks_meta": (("video_id", "track_id"), ("play_index",)),
    "plays": (("video_id", "play_index"), ()),
}
