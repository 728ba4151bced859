"""Spark schemas of the engine's entities, as DDL."""

from __future__ import annotations

DEFINITION = "STRUCT<term: STRING, definition: STRING>"
SECTION = f"STRUCT<section: STRING, title: STRING, text: STRING, definitions: ARRAY<{DEFINITION}>>"
ARTICLE = f"STRUCT<article: STRING, title: STRING, text: STRING, sections: ARRAY<{SECTION}>, definitions: ARRAY<{DEFINITION}>>"

CLAUSE = "deal_id STRING, chunk_index INT, label STRING, original_text STRING, combined_text STRING, deal_name STRING"
VECTOR = (
    "chunk_id STRING, embedding ARRAY<FLOAT>, deal_id STRING, deal_name STRING, label STRING, original_text STRING, combined_text STRING, "
    "categories ARRAY<STRING>, chunk_index INT, clause_summary STRING, extra MAP<STRING, STRING>"
)
JOB = (
    "deal_id STRING, cik STRING, acquire_name STRING, target_name STRING, announce_date TIMESTAMP, embedding_status STRING, file_url STRING, "
    "parsed_json_url STRING, flattened_json_url STRING, schema_results STRING, schema_processing_completed BOOLEAN, "
    "schema_processing_timestamp TIMESTAMP, error_message STRING, created_at TIMESTAMP, updated_at TIMESTAMP, version INT"
)
THREAD = "thread_id STRING, user_id STRING, external_id STRING, name STRING, created_at TIMESTAMP"
MESSAGE = "message_id STRING, thread_id STRING, role STRING, content STRING, created_at TIMESTAMP"
API_LOG = "endpoint STRING, method STRING, status_code INT, request_data STRING, response_data STRING, created_at TIMESTAMP"
SHEET_ROW = "target_name STRING, cik STRING, extra MAP<STRING, STRING>"
FIELD = "section_ord INT, section STRING, field_ord INT, field_name STRING, instructions STRING, categories ARRAY<STRING>"
FIELD_RESULT = "section STRING, field_name STRING, answer STRING, error STRING, categories_used ARRAY<STRING>"

#: The states of a job, in the order they are passed.
STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
