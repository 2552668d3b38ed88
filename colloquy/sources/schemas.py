"""Row types and fixed enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

WORD = "struct<start: double, end: double, word: string>"
ASR_SEGMENT = f"start double, end double, text string, words array<{WORD}>, language string, language_confidence double"
CANDIDATES = "array<struct<voice_profile_id: bigint, score: double, display_name: string>>"
ACTION_ITEMS = "array<struct<task: string, owner: string, deadline: string>>"
SUMMARY = (
    f"topic string, summary_bullets array<string>, decisions array<string>, action_items {ACTION_ITEMS}, tone_score double, "
    "emotional_summary string, questions struct<total_count: bigint, types: map<string, bigint>, extracted: array<string>>"
)

SEGMENTS = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

#: The states of jobs and recordings.
JOB_STATUSES = ("queued", "started", "finished", "failed")
RECORDING_STATUSES = ("Queued", "Processing", "Stopping", "Stopped", "NeedsReview", "Ready", "Published", "Quarantine", "Failed")
REVIEW_STATUSES = ("NeedsReview",)
CHUNK_STATUSES = ("planned", "running", "completed", "failed", "cancelled", "split")
REVIEW_STATES = ("confirmed_canonical", "kept_unknown", "local_label", "system_suggested")
GLOSSARY_KINDS = ("company", "person", "product", "project", "term")
JOB_TYPES = ("ingest", "precheck", "stt", "diarize", "align", "language", "llm", "metrics", "publish", "cleanup")
#: Stages with their order, their progress on completion, and their label.
STAGES = (
    ("sanitize_audio", 10, 0.02, "Sanitize Audio"),
    ("precheck", 20, 0.05, "Precheck"),
    ("calendar_refresh", 30, 0.08, "Calendar Refresh"),
    ("asr", 40, 0.35, "ASR"),
    ("diarization", 50, 0.60, "Diarization"),
    ("language_analysis", 60, 0.75, "Language Analysis"),
    ("speaker_turns", 70, 0.80, "Speaker Turns"),
    ("snippet_export", 75, 0.84, "Snippet Export"),
    ("llm_extract", 80, 0.90, "LLM Extract"),
    ("export_artifacts", 90, 0.95, "Export Artifacts"),
    ("metrics", 100, 0.98, "Metrics"),
    ("routing", 110, 0.99, "Routing"),
)
