"""License scan: ordered signature rules over the words of a text.

A text's words are found in its bytes. Positions of keyword hashes open windows
of ``REACH`` words to either side; only there do the rules of
``license_rules.RULES`` run, on the window's words joined by spaces. Of
overlapping detections the longer (containing) one stays, then the one of
higher priority, then the earlier rule. Base phrases are found by comparing
word hashes at every position and are never suppressed.

Rows are independent: no shuffle, and a batch's arrays bound the memory.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowscribe.llm.license_rules import BASE, KEYWORDS, RULES
from rowscribe.llm.words import ALPHANUMERIC, FOLD_CASE, inside_texts, pieces, windows, words_of

REACH = 16
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,priority:int,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: see ``SCHEMA``; ``detections`` has the rules' finds as word ranges.

    A-Z is lower-cased; words are runs of digits, letters and non-ASCII
    characters; null is empty. Without base phrases first_word and last_word are
    null; label lists without labels are empty strings. The score is that of the
    best detection (priority / 100), 1 with a base phrase, 0 without any. Repeated
    rows give repeated results; other columns are not read.
    """
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(_scan, SCHEMA)


@cache
def _rules():
    """Rules by the keyword they need: every rule has at least one literal word of KEYWORDS."""
    return [(priority, label, re.compile(rf"(?<!\w){body}(?!\w)")) for priority, label, body in RULES]


@cache
def _hashes():
    of = lambda texts: words_of(pa.array(texts), ALPHANUMERIC)
    base = []
    for phrase, label in BASE:
        n = len(phrase.split())
        base.append((n, windows(of([phrase]).hashes, n)[0], label))
    return np.sort(of(KEYWORDS).hashes), base


def _scan(batches):
    keywords, base = _hashes()
    for batch in pieces(batches):
        words = words_of(batch.column("text"), ALPHANUMERIC, FOLD_CASE)
        n, texts = len(words.starts), batch.num_rows
        finds: dict[int, list] = {}
        n_base, first, last = np.zeros(texts, np.int64), [None] * texts, [None] * texts
        labels: list[set] = [set() for _ in range(texts)]
        for size, wanted, label in base:
            at = np.flatnonzero(windows(words.hashes, size) == wanted)
            at = at[inside_texts(words.first, n, size)[at]]
            text = np.searchsorted(words.first, at, "right") - 1
            np.add.at(n_base, text, 1)
            for t, place in zip(text.tolist(), (at - words.first[text]).tolist(), strict=True):
                labels[t].add(label)
                first[t] = place if first[t] is None else min(first[t], place)
                last[t] = place if last[t] is None else max(last[t], place)
        hits = np.flatnonzero(np.isin(words.hashes, keywords))
        for t, low, high in _windows(hits, words.first):
            found = _matches(words, low, high)
            if found:
                finds.setdefault(t, []).extend((p, name, a - words.first[t], b - words.first[t], order) for p, name, a, b, order in found)
        best = [settle(finds.get(t, [])) for t in range(texts)]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": np.diff(words.first),
                "n_base": n_base,
                "first_word": pa.array(first, pa.int64()),
                "last_word": pa.array(last, pa.int64()),
                "base_labels": [",".join(sorted(x)) for x in labels],
                "labels": [",".join(sorted(x | {f["label"] for f in found})) for x, found in zip(labels, best, strict=True)],
                "score": [1.0 if x else max((f["priority"] / 100 for f in found), default=0.0) for x, found in zip(labels, best, strict=True)],
                "detections": pa.array(best, pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
            }
        )


def _windows(hits: np.ndarray, first: np.ndarray):
    """(text, from word, to word) around keyword positions, near ones merged."""
    if not len(hits):
        return
    text = np.searchsorted(first, hits, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (np.diff(hits) > 2 * REACH)]))
    for a, b in zip(new, [*new[1:], len(hits)], strict=True):
        t = int(text[a])
        yield t, int(max(first[t], hits[a] - REACH)), int(min(first[t + 1], hits[b - 1] + REACH + 1))


def _matches(words, low: int, high: int) -> list[tuple]:
    raw = words.data
    spans = [bytes(raw[s:e]).decode("utf-8", "replace").translate(_LOWER) for s, e in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist(), strict=True)]
    text = " ".join(spans)
    begun = np.cumsum([0, *[len(s) + 1 for s in spans]])
    out = []
    for order, (priority, label, rule) in enumerate(_rules()):
        for m in rule.finditer(text):
            a = int(np.searchsorted(begun, m.start(), "right")) - 1
            b = int(np.searchsorted(begun, m.end() - 1, "right"))
            out.append((priority, label, low + a, low + b, order))
    return out


_LOWER = {i: i + 32 for i in range(65, 91)}


def settle(found: list[tuple]) -> list[dict]:
    """Detections that stay: longer before shorter, then priority, then rule order; none overlaps one before it."""
    kept: list[tuple] = []
    for f in sorted(set(found), key=lambda f: (-(f[3] - f[2]), -f[0], f[4], f[2])):
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    return [{"label": f[1], "priority": int(f[0]), "start": int(f[2]), "end": int(f[3])} for f in sorted(kept, key=lambda f: f[2])]
