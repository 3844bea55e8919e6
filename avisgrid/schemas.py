"""Column contracts of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no session, so workers can import it."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LANDED = _struct(
    "source_review_id string, brand_code string, source_code string, review_date timestamp, "
    "rating int, text string, author_handle string, app_version string, "
    "vendor_response string, vendor_response_at timestamp, collected_at timestamp"
)

RAW = _struct(
    "source_review_id string, source_code string, brand_code string, review_date timestamp, "
    "rating int, text string, author_handle string, app_version string, "
    "vendor_response string, vendor_response_at timestamp, collected_at timestamp, "
    "is_exploitable boolean, exclusion_reason string, category_code string, "
    "category_source string, persona_code string, severity_code string, "
    "severity_rating_score double, severity_text_score double, classified_at timestamp"
)

# Raw reviews as the warehouse keeps them: a partition for each run.
RAW_RUNS = T.StructType([*RAW.fields, T.StructField("run_id", T.StringType())])

SEEDS = {
    "brands": _struct("id int, code string, label string, is_focus boolean"),
    "sources": _struct("id int, code string, label string, type string, url string"),
    "categories": _struct(
        "id int, code string, label string, description string, is_critical boolean"
    ),
    "severities": _struct("id int, code string, label string, rank int"),
    "personas": _struct("id int, code string, label string"),
    "ticket_statuses": _struct("id int, code string, label string, is_terminal boolean"),
}

FACT_REVIEWS = (
    "id", "review_key", "source_review_id", "source_id", "brand_id", "date_id", "review_date",
    "persona_id", "rating", "text", "language", "author_handle", "app_version",
    "vendor_responded", "vendor_response_at", "response_latency_days", "is_exploitable",
    "exclusion_reason", "collected_at",
)

FACT_CLASSIFICATIONS = (
    "id", "review_id", "review_key", "category_id", "severity_id", "severity_rating_score",
    "severity_text_score", "confidence", "method", "classified_at",
)

FACT_TICKETS = (
    "id", "review_id", "review_key", "external_ticket_id", "status_id", "severity_id", "channel",
    "assignee", "created_at", "resolved_at", "resolution_notes",
)

ALERTS = (
    "alert_id", "detected_at", "brand", "category", "current_week", "current_high",
    "baseline_avg_high", "ratio",
)

TICKETS = (
    "ticket_id", "review_id", "occurred_at", "brand", "source", "category", "severity", "rating",
    "status", "owner_team", "excerpt",
)
