"""Row types of the files read and written."""

from __future__ import annotations

PAYLOAD = (
    "_target_course_requested STRING, _expected_decision STRING, _description STRING, "
    "facts ARRAY<STRUCT<factType: STRING, factKey: STRING, factValue: STRING, "
    "factJson: STRUCT<items: ARRAY<STRING>>, unknown: BOOLEAN>>"
)
PROFILE = (
    "code STRING, display_name STRING, target_credits INT, target_lab_required BOOLEAN, "
    "required_topics ARRAY<STRING>, required_outcomes ARRAY<STRING>"
)
LOG_EVENT = (
    "ts TIMESTAMP, expires_at TIMESTAMP, event STRING, request_id STRING, actor STRING, status STRING, step STRING, "
    "extra STRING"
)
VOTE = "vote_id LONG, request_id LONG, review_cycle INT, voter_id LONG, action STRING, created_at TIMESTAMP_NTZ"
COURSE_CSV = (
    "course_code STRING, subject STRING, number STRING, suffix STRING, title STRING, credits_min STRING, "
    "prerequisites STRING, description STRING"
)
OUTCOME_CSV = "course_code STRING, learning_outcomes STRING"
