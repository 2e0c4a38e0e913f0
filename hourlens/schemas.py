"""Fixed schemas of the tables the jobs read and write (Spark DDL)."""

EMPLOYEE = "uuid BIGINT, name STRING, alias STRING, department STRING"
PROJECT = "uuid BIGINT, project_reference_id STRING, name STRING"
WORK_HOUR = (
    "employee_id BIGINT, project_id BIGINT, work_type STRING, hours DOUBLE, "
    "start_date DATE, end_date DATE"
)
DICTIONARY = "entity_type STRING, entity STRING"
ALIASES = (
    "entity_type STRING, canonical STRING, canonical_seq INT, alias STRING, alias_seq INT"
)
SLOTS = "ARRAY<STRUCT<placeholder: STRING, type: STRING, ordinal: INT>>"
TEMPLATES = (
    "template_id BIGINT, template_query STRING, sql_template STRING, "
    f"slots {SLOTS}, source STRING, intent STRING, tables_used ARRAY<STRING>, "
    "usage_count BIGINT, success_rate DOUBLE, last_used TIMESTAMP_NTZ, "
    "created_at TIMESTAMP_NTZ, needs_review BOOLEAN"
)
QUESTIONS = "question_id BIGINT, session_id BIGINT, ts TIMESTAMP_NTZ, text STRING"
MENTIONS = (
    "question_id BIGINT, entity_type STRING, ordinal INT, value STRING, "
    "normalized STRING, variations ARRAY<STRING>"
)
FEEDBACK = (
    "template_id BIGINT, event_id BIGINT, ts TIMESTAMP_NTZ, success BOOLEAN, "
    "execution_ms DOUBLE, error STRING"
)
REQUESTS = "request_id BIGINT, ts TIMESTAMP_NTZ, hit BOOLEAN, ms DOUBLE"
