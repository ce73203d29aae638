"""Prompts and cache keys as columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions.text import squash, strip


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _object_sha(value: dict | None) -> str:
    # Sorted keys: the order in which a user wrote them does not matter.
    return _sha(json.dumps(value or {}, ensure_ascii=False, sort_keys=True))


def normalized_input(input_json: Column, review_text: Column) -> Column:
    """The text that identifies a row: its input, or its review without one."""
    chosen = F.when(F.coalesce(input_json, F.lit("")) != "", input_json).otherwise(review_text)
    return squash(F.coalesce(chosen, F.lit("")))


def cache_keys(
    normalized: Column,
    *,
    provider: str,
    model: str,
    mode: str,
    prompt_template: str,
    template: dict | None,
    schema: dict | None,
    review_hash: Column | None = None,
) -> dict[str, Column]:
    """The cache key and the four hashes it is built from.

    Everything but the row is constant for a job and hashed once on the driver.
    ``review_hash`` may name a column that already holds the hash of the row.
    """
    prompt_hash, template_hash, schema_hash = (
        _sha(prompt_template),
        _object_sha(template),
        _object_sha(schema),
    )
    head = "\n".join([provider, model, mode, prompt_hash, template_hash, schema_hash])
    review_hash = F.sha2(normalized, 256) if review_hash is None else review_hash
    return {
        "cache_key": F.sha2(F.concat(F.lit(head + "\n"), review_hash), 256),
        "prompt_hash": F.lit(prompt_hash),
        "review_hash": review_hash,
        "expected_template_hash": F.lit(template_hash),
        "output_schema_hash": F.lit(schema_hash),
    }


def _answer_block(template: dict) -> str:
    expected = json.dumps(template, ensure_ascii=False, indent=2)
    return "\n\n" + "\n".join([*K.ANSWER_RULES, expected]) + "\n"


def render_prompt(
    prompt_template: str, input_json: Column, mode: str = "custom", template: dict | None = None
) -> Column:
    """Place the row in every ``{row_json}`` or after the text, then the answer block."""
    data = F.when(F.coalesce(input_json, F.lit("")) != "", input_json).otherwise(F.lit("{}"))
    if "{row_json}" in prompt_template:
        pieces = prompt_template.split("{row_json}")
        parts = [F.lit(pieces[0])]
        for piece in pieces[1:]:
            parts += [data, F.lit(piece)]
        prompt = F.concat(*parts)
    else:
        prompt = F.concat(F.lit(f"{prompt_template.rstrip()}\n\n{K.DATA_HEADING}\n"), data)
    if mode == "custom" and template:
        prompt = F.concat(strip(prompt), F.lit(_answer_block(template)))
    return prompt


def with_feedback(prompt: Column, error: Column, previous: Column) -> Column:
    """The prompt of a second attempt: what was wrong and the cut answer."""
    answer = F.coalesce(previous, F.lit(""))
    cut = F.when(
        F.length(answer) > K.FEEDBACK_CHARS,
        F.concat(F.substring(answer, 1, K.FEEDBACK_CHARS), F.lit("…")),
    ).otherwise(answer)
    reason = strip(F.coalesce(error, F.lit("")))
    lines = F.array_compact(
        F.array(
            F.rtrim(prompt, F.lit(K.WHITESPACE)),
            F.lit(""),
            F.lit(K.FEEDBACK_INTRO),
            F.when(reason != "", F.concat(F.lit(K.FEEDBACK_REASON), reason)),
            F.when(cut != "", F.concat(F.lit(K.FEEDBACK_ANSWER), cut)),
            F.lit(K.FEEDBACK_OUTRO),
        )
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))
