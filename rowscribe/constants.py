"""Markers, limits, patterns and message formats.

They decide results (which cell counts as empty, which text an error row
carries), so they are kept together here and stated as plain values.
"""

# --- Fixed values: cells that count as empty, compared in lower case ---------
EMPTY_MARKERS = ["", "nan", "none", "null", "n/a", "na", "-"]

# Characters removed at both ends of a cell (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: limits and defaults -------------------------------------
FIRST_DATA_ROW = 2
MAX_UPLOAD_BYTES = 200 * 1024 * 1024
DISTINCT_CAP = 100_000
GROUP_MAX_ROWS = 100_000
RETRIES = 2
PARALLEL_CALLS = 12
MAX_EXACT_CACHE_ROWS = 2_000_000
MAX_SEMANTIC_CACHE_ROWS = 500_000
SEMANTIC_THRESHOLD = 0.94
SEMANTIC_CANDIDATES = 200
KEEP_LAST_REPORTS = 20
ORPHAN_TTL_HOURS = 24
PROGRESS_EVERY_ROWS = 20
PROGRESS_EVERY_SECONDS = 1.0
KEEPALIVE_SECONDS = 15.0
LEASE_SECONDS = 30
STALE_SECONDS = 90
DEDUP_SECONDS = 3600
SLOW_ACCESS_MS = 250
PREVIEW_ROWS = 10
FEEDBACK_CHARS = 500
FALLBACK_COMPLETION_TOKENS = 40

# --- Fixed values: states ----------------------------------------------------
ACTIVE_STATUSES = ["running", "queued", "paused"]
TERMINAL_STATUSES = ["completed", "failed", "canceled"]
FINISHED_ROW_STATUSES = ["done", "error"]
UNFINISHED_ROW_STATUSES = ["pending", "in_progress", "queued"]
BUSY_UPLOAD_STATUSES = ["queued", "parsing"]
TERMINAL_STEPS = {
    "completed": "Завершено",
    "failed": "Ошибка",
    "canceled": "Отменено",
}
TRUE_WORDS = ["1", "true", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "no", "n", "off"]

# --- Fixed values: reserved result keys -------------------------------------
RESERVED_KEYS = ["row_number", "review_text", "input_json", "warnings", "error"]

# --- Fixed values: step texts that only repeat the progress or the status ----
REPEATED_STEP_PATTERN = r"^(Обработка|На паузе)\s+\d+/\d+\s*$"
REPEATED_STEPS = [
    "В очереди",
    "Завершено",
    "Готово",
    "Отменено пользователем",
    "Отменено",
    "Ошибка",
    "На паузе",
]

# --- Fixed values: secrets masked in text (pattern, replacement) -------------
SECRET_PATTERNS = [
    (r"(?i)(authorization:\s*bearer\s+)[^\s,;]+", "$1***"),
    (r"(?i)(api[_-]?key[\"']?\s*[:=]\s*[\"'])[^\"']+([\"'])", "$1***$2"),
    (r"(?i)(password[\"']?\s*[:=]\s*[\"'])[^\"']+([\"'])", "$1***$2"),
    (r"(?i)(token[\"']?\s*[:=]\s*[\"'])[^\"']+([\"'])", "$1***$2"),
]

# --- Fixed values: signs of a prompt that is longer than the model accepts ----
OVERFLOW_CODES = ["context_length_exceeded", "string_above_max_length"]
OVERFLOW_HINTS = {
    "openai": [
        "maximum context length",
        "context length",
        "context_length",
        "too many tokens",
        "too long",
    ],
    "ollama": ["context", "too long", "exceeds", "maximum"],
}

# --- Fixed values: request paths whose fast and successful calls are noise -----
NOISY_PATH_PREFIXES = ["/api/jobs/", "/api/reports", "/api/auth/usage", "/api/health"]

# --- Fixed values: header words that suggest the review column ---------------
REVIEW_HEADER_WORDS = ["review", "отзыв"]

# --- Fixed values: characters that may not appear in a file name ---------------
UNSAFE_NAME_CHARS = r"[\\/:*?\"<>|\x00-\x1f]"

# --- Fixed values: text blocks of a prompt -----------------------------------
DATA_HEADING = "Данные строки:"
ANSWER_RULES = [
    "Верни только валидный JSON без markdown и без лишнего текста.",
    "Промпт выше определяет смысл заполнения полей.",
    "EXPECTED_JSON ниже определяет только структуру ответа, типы данных и допустимые значения.",
    "Используй те же ключи, что и в EXPECTED_JSON.",
    "Не добавляй новые поля и не возвращай входные поля строки, если их нет в EXPECTED_JSON.",
    "Не копируй служебные значения схемы (`type`, `values`, `min`, `max`, `items`, `properties`) в ответ.",
    "Если у поля `type: enum`, верни одно значение из его массива `values`.",
    "EXPECTED_JSON:",
]
FEEDBACK_INTRO = "Предыдущий ответ не прошёл проверку — исправь и верни заново."
FEEDBACK_REASON = "Причина ошибки: "
FEEDBACK_ANSWER = "Прошлый ответ (сокращён до 500 символов): "
FEEDBACK_OUTRO = "Верни корректный JSON строго по EXPECTED_JSON, без повторения ошибок."

# --- Fixed values: error texts of the answer check ----------------------------
MSG_NOT_OBJECT = "Ожидался JSON-объект в ответе модели"
MSG_ECHO = "Модель вернула входные данные вместо результата по Ожидаемому JSON"
MSG_MISSING = "В ответе отсутствует обязательное поле: "
MSG_STRING = "' должно быть строкой"
MSG_MIN_LENGTH = "' должно содержать не менее {} символов"
MSG_MAX_LENGTH = "' должно содержать не более {} символов"
MSG_DATE = "' должно быть датой в формате YYYY-MM-DD"
MSG_DATETIME = "' должно быть датой-временем в ISO-формате"
MSG_ENUM = "' должно быть одним из: {}"
MSG_NUMBER = "' должно быть числом"
MSG_INTEGER = "' должно быть целым числом"
MSG_MINIMUM = "' должно быть >= {}"
MSG_MAXIMUM = "' должно быть <= {}"
MSG_BOOLEAN = "' должно быть boolean"
MSG_ARRAY = "' должно быть массивом"
MSG_MIN_ITEMS = "' должно содержать не менее {} элементов"
MSG_MAX_ITEMS = "' должно содержать не более {} элементов"
MSG_OBJECT = "' должно быть объектом"
MSG_OBJECT_KEYS = "' должно содержать обязательные ключи: "
MSG_FIELD = "Поле '"

# --- Fixed values: error texts of rows -----------------------------------------
MSG_LARGE_GROUP = ("Пропущено: группа слишком большая (", " строк > лимита ", ").")
MSG_OVERFLOW = (
    "Промпт превысил контекст модели `",
    "`. Уменьшите размер группы (`group_max_rows`) или используйте модель с большим контекстом.",
)
MSG_RETRIES = "Ошибка LLM после повторов: "

# --- Fixed values: error texts of jobs that cannot be recovered ------------------
MSG_NO_CONTEXT = "Задача не может быть восстановлена: отсутствует контекст запуска"
MSG_NO_KEY = "Задача не может быть восстановлена: для OpenAI не сохранен API-токен"

# --- Fixed values: notes of failed embedding calls -------------------------------
NOTE_EMBEDDER_MISSING = "semantic_cache_disabled_endpoint_404"
NOTE_EMBEDDING_FAILED = "semantic_cache_error"

# --- Fixed values: remaining-time texts ---------------------------------------
ETA_PREFIX = "Осталось ~"
ETA_SECONDS = " сек"
ETA_MINUTES = " мин"
ETA_HOURS = " ч"

# --- Fixed values: answer of the built-in sentiment schema ---------------------
SENTIMENT_TEMPLATE = {
    "category": {"type": "string", "min_length": 1, "max_length": 120},
    "sentiment_label": {"type": "enum", "values": ["negative", "neutral", "positive"]},
    "negativity_score": {"type": "number", "min": 0, "max": 1},
    "summary": {"type": "string", "min_length": 1, "max_length": 240},
}

# --- Fixed values: the group risk roll-up --------------------------------------
RISK_LOW, RISK_MEDIUM, RISK_HIGH = "низкий", "средний", "высокий"
RISK_OVERRIDING_SCHEME = "вымогательство"
