"""A deterministic annotator and embedder, in place of a paid model.

They react to the remainders of the input's length, so that every way a call can end
(answer, repaired answer, broken answer, failure, prompt too long) occurs.
"""

from __future__ import annotations

import json

from rowscribe.operators.annotate import PromptTooLong

PROMPT = "Rate the review.\nROW={row_json}\nAnswer with the fields below."
TEMPLATE = {
    "category": {"type": "enum", "values": ["en", "de", "fr", "es", "none"]},
    "score": {"type": "number", "min": 0, "max": 1},
    "chars": {"type": "integer", "min": 0},
}


def annotator(prompt: str) -> tuple[str, str | None]:
    lines = prompt.split("\n")
    row = json.loads(next(line[4:] for line in lines if line.startswith("ROW=")))
    size = row["group_size"] if "group_size" in row else len(row.get("review") or "")
    repaired = len(lines) > 3 and any("0.7e1" in line for line in lines[3:])
    if size % 101 == 50:
        raise PromptTooLong("rules-1", "maximum context length")
    if size % 97 == 13:
        raise RuntimeError("busy")
    if size % 53 == 7:
        return "[]", None
    score = "0.7e1" if size % 5 == 0 and not repaired else f"0.{size % 10}"
    extra = ',"extra":true' if size % 7 == 0 else ""
    answer = f'{{"category":"{row.get("lang") or "none"}","score":{score},"chars":{size}{extra}}}'
    usage = {"prompt_tokens": size, "completion_tokens": 5, "total_tokens": size + 5}
    return answer, json.dumps({"usage": usage} if size % 2 == 0 else {"usage": None})


# The same rules in SQL; ``n`` is the size, ``lang`` and ``review_text`` come with the row.
SQL = """ruled AS (
  SELECT *, CASE WHEN n % 101 = 50 THEN 'long' WHEN n % 97 = 13 THEN 'busy' WHEN n % 53 = 7 THEN 'list'
                 WHEN n % 5 = 0 THEN 'repaired' ELSE 'ok' END AS course FROM sized),
annotated AS (
  SELECT *, CASE WHEN course IN ('ok','repaired') THEN '{"category":"' || coalesce(lang, 'none') || '","score":0.' || (n % 10)
              || ',"chars":' || n || '}' END AS custom_json,
         CASE course WHEN 'long' THEN 'Промпт превысил контекст модели `rules-1`. Уменьшите размер группы (`group_max_rows`) или используйте модель с большим контекстом.'
              WHEN 'busy' THEN 'Ошибка LLM после повторов: RuntimeError: busy'
              WHEN 'list' THEN 'Ошибка LLM после повторов: ValueError: Ожидался JSON-объект в ответе модели' END AS error_text,
         CAST(CASE WHEN course NOT IN ('ok','repaired') THEN 0 WHEN n % 2 = 0 THEN n ELSE greatest(1, length(review_text) // 4) END AS INTEGER) AS prompt_tokens,
         CAST(CASE WHEN course NOT IN ('ok','repaired') THEN 0 WHEN n % 2 = 0 THEN n + 5 ELSE greatest(1, length(review_text) // 4) + 40 END AS INTEGER) AS total_tokens,
         CASE course WHEN 'long' THEN 'context_length_exceeded:maximum context length' WHEN 'list' THEN 'cache_disabled,cache_disabled'
              WHEN 'busy' THEN NULL
              WHEN 'ok' THEN CASE WHEN n % 7 = 0 THEN 'dropped_extra_keys:extra' END
              ELSE CASE WHEN n % 7 = 0 THEN 'dropped_extra_keys:extra,cache_disabled,dropped_extra_keys:extra' ELSE 'cache_disabled' END
              END AS notes
  FROM ruled)"""


def embedder(text: str) -> list[float]:
    """Length, vowels and blanks of a text as a small vector."""
    return [float(len(text)), float(sum(text.count(v) for v in "aeiou")), float(text.count(" "))]


def language_embedder(text: str) -> list[float]:
    """Which of three languages a packed row names; zero for any other."""
    return [float(f'"lang":"{name}"' in text) for name in ("en", "de", "fr")]
