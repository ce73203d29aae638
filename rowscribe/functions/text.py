"""Text columns: cell cleaning, masking, names and status texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscribe import constants as K

# The same white space for regular expressions: (?U) makes \\s mean Unicode white space.
_SPACES = r"(?U)[\s\x1c-\x1f]+"
_LONGEST_MARKER = max(len(marker) for marker in K.EMPTY_MARKERS)


def strip(value: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` only knows blanks)."""
    return F.btrim(value, F.lit(K.WHITESPACE))


def squash(value: Column) -> Column:
    """Replace every run of white space by one blank and strip the ends."""
    return F.trim(F.regexp_replace(value, _SPACES, " "))


def is_blank(value: Column) -> Column:
    return value.isNull() | (strip(value) == "")


def clean_cell(value: Column) -> Column:
    """The stripped cell, or null where it only marks an empty one."""
    text = strip(value.cast("string"))
    # Long cells cannot be markers and need not be compared.
    filled = (F.length(text) > _LONGEST_MARKER) | ~F.lower(text).isin(K.EMPTY_MARKERS)
    return F.when(filled, text)


def cell_warning(value: Column) -> Column:
    """``empty_cell`` where :func:`clean_cell` gives null."""
    return F.when(clean_cell(value).isNull(), F.lit("empty_cell"))


def mask_secrets(value: Column) -> Column:
    """Mask bearer tokens, keys, passwords and tokens in any text column."""
    return reduce(
        lambda text, rule: F.regexp_replace(text, rule[0], rule[1]), K.SECRET_PATTERNS, value
    )


def file_stem(name: Column) -> Column:
    """File name without folders and without its last extension; null if blank."""
    base = F.regexp_replace(F.regexp_replace(strip(name), r"/+$", ""), r"^.*/", "")
    # A leading dot belongs to the name and a name ending in a dot keeps it.
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    return F.when(~is_blank(name), stem)


def safe_file_name(name: Column, fallback: str, extension: str) -> Column:
    """A name that is safe to save under: ``stem.extension``, stem up to 100 characters."""
    base = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), K.UNSAFE_NAME_CHARS, "_")
    base = F.btrim(base, F.lit(". "))
    base = F.when(base == "", F.lit(fallback)).otherwise(base)
    has_stem = F.instr(base, ".") > 1
    stem = F.when(has_stem, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    stem = F.substring(stem, 1, 100)
    return F.concat(F.when(stem == "", F.lit(fallback)).otherwise(stem), F.lit(f".{extension}"))


def truthy(value: Column, default: bool) -> Column:
    """Read a stored flag: known words, else the default."""
    word = F.lower(strip(value.cast("string")))
    return (
        F.when(word.isin(K.TRUE_WORDS), F.lit(True))
        .when(word.isin(K.FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(default))
    )


def is_overflow(code: Column, message: Column, provider: str = "openai") -> Column:
    """Does this provider error say that the prompt was too long?"""
    text = F.lower(F.coalesce(message, F.lit("")))
    by_hint = reduce(lambda a, b: a | b, [text.contains(h) for h in K.OVERFLOW_HINTS[provider]])
    if provider != "openai":
        return by_hint
    return F.lower(F.coalesce(code, F.lit(""))).isin(K.OVERFLOW_CODES) | by_hint


def visible_step(step: Column) -> Column:
    """The step text, or null where it only repeats progress or status."""
    text = strip(step)
    hidden = (text == "") | text.rlike(K.REPEATED_STEP_PATTERN) | text.isin(K.REPEATED_STEPS)
    return F.when(~hidden, text)


def suggested_column(columns: Column) -> Column:
    """First header that names a review, else the first header."""
    named = F.filter(
        columns,
        lambda c: reduce(
            lambda a, b: a | b, [F.lower(c).contains(word) for word in K.REVIEW_HEADER_WORDS]
        ),
    )
    return F.coalesce(F.get(named, F.lit(0)), F.get(columns, F.lit(0)))


def keep_known(chosen: Column, available: Column) -> Column:
    """Chosen columns that exist, in the chosen order."""
    return F.array_intersect(chosen, available)
