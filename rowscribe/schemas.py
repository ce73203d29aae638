"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS, _B = T.TimestampType(), T.BooleanType()
_LIST = T.ArrayType(T.StringType())

SHEET_ROW = _struct(
    row_number=_I, review_text=_S, input_json=_S, passthrough_json=_S, warnings=_LIST
)

REPORT_ROWS = _struct(
    report_id=_S,
    row_number=_I,
    review_text=_S,
    group_key=_S,
    status=_S,
    input_json=_S,
    passthrough_json=_S,
    custom_json=_S,
    raw_response_json=_S,
    warnings=_LIST,
    error_text=_S,
    prompt_tokens=_I,
    completion_tokens=_I,
    total_tokens=_I,
)

REPORTS = _struct(
    id=_S,
    job_id=_S,
    user_id=_L,
    uploaded_file_id=_S,
    status=_S,
    current_step=_S,
    total_rows=_L,
    processed_rows=_L,
    progress_percent=_D,
    eta_seconds=_D,
    group_by_column=_S,
    use_cache=_B,
    summary_json=_S,
    error_text=_S,
    created_at=_TS,
    updated_at=_TS,
    finished_at=_TS,
)

EXACT_CACHE = _struct(
    cache_key=_S,
    provider=_S,
    model=_S,
    prompt_hash=_S,
    review_hash=_S,
    analysis_json=_S,
    raw_json=_S,
    created_at=_TS,
    updated_at=_TS,
    hits=_L,
)

SEMANTIC_CACHE = _struct(
    semantic_key=_S,
    provider=_S,
    model=_S,
    analysis_mode=_S,
    prompt_hash=_S,
    expected_template_hash=_S,
    output_schema_hash=_S,
    embedding=T.ArrayType(_D),
    analysis_json=_S,
    raw_json=_S,
    created_at=_TS,
    updated_at=_TS,
    hits=_L,
)

PRESETS = _struct(
    id=_S,
    user_id=_L,
    name=_S,
    prompt_template=_S,
    expected_json_template=_S,
    template_hint=_S,
    created_at=_TS,
    updated_at=_TS,
)

LOG_RECORD = _struct(
    ts=_S,
    level=_S,
    service=_S,
    logger=_S,
    request_id=_S,
    user_id=_S,
    username=_S,
    message=_S,
)
