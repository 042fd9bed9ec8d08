"""Schemas of the stored tables. Readers use them as given; nothing is inferred."""

from veilframe.functions.masking import DECISION_TYPE
from veilframe.functions.spans import SPAN_TYPE

ACTOR = "struct<role:string,user_id:string,session_id:string>"

AUDIT = (
    f"request_id string, timestamp_utc timestamp, actor {ACTOR}, tool_name string, raw_query_hash string, "
    f"inbound_detections {SPAN_TYPE}, policy_decisions_inbound {DECISION_TYPE}, tool_input_after_policy string, "
    f"tool_output_raw_hash string, outbound_detections {SPAN_TYPE}, policy_decisions_outbound {DECISION_TYPE}, "
    "tool_output_final string, status string, latency_ms double, review_queue_id string, policy_version string, "
    "model_version string"
)

TOTALS = "request_id string, timestamp_utc timestamp, status string, rows long, detections long, rows_hash string"

REVIEW = (
    f"review_id string, request_id string, timestamp_utc timestamp, actor {ACTOR}, tool_name string, "
    f"direction string, detections {SPAN_TYPE}, query_or_result_hash string, status string"
)

VAULT = (
    "vault_ref string, request_id string, timestamp_utc timestamp, category string, "
    "original_text string, context_hash string"
)

GOLDEN = (
    "role string, query string, expected_status string, expected_rbac string, description string, "
    "expected_inbound_categories array<string>"
)

REQUESTS = (
    "request_id string, ts timestamp, role string, user_id string, tool_name string, query string, "
    "customer_id long, name string, email string, limit int, fields string, scan_text string"
)

REVIEW_EVENTS = "request_id string, ts timestamp, kind string, action string, reason string"

HELD = f"{REVIEW_EVENTS}, payload string"
