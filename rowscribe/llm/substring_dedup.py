"""Repeated passages, removed after a relative Lempel-Ziv parse.

Every block of texts is an indexed reference block for all others. The index
holds sampled phrases: of each ``window`` of words it holds the phrase of half
that length whose hash is least (winnowing), so equal windows hold equal
phrases. A text is parsed greedily against the index: consecutive sampled
phrases that lie at one distance from one reference form a factor, which is an
exact copy because neighbouring phrases overlap or touch. Factors of a window or
more become duplicate spans. Windows at factor boundaries, which no long factor
settles, are checked one by one: their phrases are contested, and every block
that holds a contested phrase sends the windows it was chosen in. So a word is
removed if and only if a window over it also starts elsewhere.

Texts are shuffled once (by block); phrases, about a tenth of the words, and
boundary windows reach their buckets once for each block. Equality is that of
64-bit hashes. One text must fit into a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowscribe.llm import blocks as B
from rowscribe.llm.words import NOT_SPACE, Words, inside_texts, join_words, windows, words_of

ASKED = "bucket int, block int, hashes binary, places binary, several binary"
TOLD = "block int, kind int, hashes binary, blocks binary, places binary"
PHRASE, CONTESTED, WINDOW = 0, 1, 2


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, kept (text), n_words, n_removed and spans (word ranges taken out) of every row.

    Words are runs of characters other than space and tab to carriage return.
    Kept words are joined by one space. A null text has no words and an empty
    ``kept``. Repeated rows count as places of their own. Other columns of
    ``docs`` are not read. An empty table gives an empty table.
    """
    if window < 3:
        raise ValueError("window must be 3 words or more")
    count = B.block_count(docs)
    placed = B.in_blocks(docs, count)
    parse = Parse(window, count)
    phrases = placed.groupBy("block").applyInArrow(lambda t: parse.ask_phrases(t), ASKED)
    known = phrases.groupBy("bucket").applyInArrow(tell_phrases, TOLD)
    open_ = placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda t, told: parse.ask_open(t, told), ASKED)
    contested = phrases.groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(tell_contested, TOLD)
    asked = placed.groupBy("block").cogroup(contested.groupBy("block")).applyInArrow(lambda t, told: parse.ask_windows(t, told), ASKED)
    repeated = asked.groupBy("bucket").applyInArrow(tell_windows, TOLD)
    return placed.groupBy("block").cogroup(known.unionByName(repeated).groupBy("block")).applyInArrow(
        lambda t, told: parse.cut(t, told), "doc_id long, kept string, n_words long, n_removed long, spans array<struct<start:long,end:long>>"
    )


class Parse:
    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.phrase = window // 2 + 1
        self.choices = window - self.phrase + 1  # phrases in a window

    def ask_phrases(self, table: pa.Table) -> pa.Table:
        words = words_of(B.ordered(table)["text"], NOT_SPACE)
        chosen = self._chosen(words)
        at = np.unique(chosen[chosen >= 0])
        return self._asked(table, self._grams[at], _places(words, at))

    def ask_open(self, table: pa.Table, told: pa.Table) -> pa.Table:
        words = words_of(B.ordered(table)["text"], NOT_SPACE)
        _, open_ = self._factors(table, words, told)
        at = np.unique(self._chosen(words)[open_])
        return self._asked(table, self._grams[at], at)

    def ask_windows(self, table: pa.Table, told: pa.Table) -> pa.Table:
        words = words_of(B.ordered(table)["text"], NOT_SPACE)
        chosen = self._chosen(words)
        at = np.flatnonzero(chosen >= 0)
        at = at[np.isin(self._grams[chosen[at]], B.joined(told["hashes"], np.uint64)[0])] if told.num_rows else at[:0]
        return self._asked(table, windows(words.hashes, self.window)[at], at)

    def cut(self, table: pa.Table, told: pa.Table) -> pa.Table:
        table = B.ordered(table)
        words = words_of(table["text"], NOT_SPACE)
        settled, open_ = self._factors(table, words, told)
        at = np.flatnonzero(open_)
        told = told.filter(pa.compute.equal(told["kind"], WINDOW)) if told.num_rows else told
        repeated, _ = B.joined(told["hashes"], np.uint64)
        if len(at) and len(repeated):
            settled[at[np.isin(windows(words.hashes, self.window)[at], repeated)]] = True
        n = len(words.starts)
        steps = np.zeros(n + 1, np.int32)
        begun = np.flatnonzero(settled)
        np.add.at(steps, begun, 1)
        np.add.at(steps, begun + self.window, -1)
        gone = np.cumsum(steps)[:n] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "kept": join_words(words, ~gone),
                "n_words": np.diff(words.first),
                "n_removed": np.diff(total[words.first]),
                "spans": _spans(gone, words.first),
            }
        )

    def _chosen(self, words: Words) -> np.ndarray:
        """For each word position, where the phrase of least hash in the window from there starts; -1 without a window."""
        self._grams = grams = windows(words.hashes, self.phrase)
        n = len(words.starts)
        out = np.full(n, -1, np.int64)
        m = n - self.window + 1
        if m <= 0:
            return out
        best, width = np.arange(len(grams)), 1
        later = lambda a, b: np.where(grams[b] <= grams[a], b, a)  # noqa: E731  of equal hashes the later one
        while width * 2 <= self.choices:
            best = later(best[:-width], best[width:])
            width *= 2
        if width < self.choices:
            shift = self.choices - width
            best = later(best[: len(best) - shift], best[shift:])
        out[:m] = np.where(inside_texts(words.first, n, self.window)[:m], best[:m], -1)
        return out

    def _asked(self, table: pa.Table, hashes: np.ndarray, places: np.ndarray) -> pa.Table:
        found, first, times = np.unique(hashes, return_index=True, return_counts=True)
        block = table["block"][0].as_py() if table.num_rows else 0
        rows = [(b, block, found[s].tobytes(), places[first[s]].astype(np.uint32).tobytes(), (times[s] > 1).tobytes()) for b, s in B.bucket_slices(found, self.buckets)]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["bucket", "block", "hashes", "places", "several"]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    def _factors(self, table: pa.Table, words: Words, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which windows a long factor settles, and which are open: their phrase is known elsewhere, but no factor covers them."""
        n = len(words.starts)
        chosen = self._chosen(words)
        valid = chosen >= 0
        settled, open_ = np.zeros(n, bool), np.zeros(n, bool)
        told = told.filter(pa.compute.equal(told["kind"], PHRASE)) if told.num_rows else told
        hashes, _ = B.joined(told["hashes"], np.uint64)
        if not len(hashes) or not valid.any():
            return settled, open_
        ref_blocks, ref_places = B.joined(told["blocks"], np.int32)[0], B.joined(told["places"], np.uint32)[0].astype(np.int64)
        order = np.argsort(hashes)
        hashes, ref_blocks, ref_places = hashes[order], ref_blocks[order], ref_places[order]
        at = np.unique(chosen[valid])
        grams = self._grams[at]
        slot = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        known = hashes[slot] == grams
        own = _places(words, at)
        block, place = ref_blocks[slot], ref_places[slot]
        # A first place that refers to itself takes the block's second place of the phrase.
        itself = known & (block == table["block"][0].as_py()) & (place == own)
        if itself.any():
            by = np.argsort(grams, kind="stable")
            follows = np.flatnonzero(grams[by[1:]] == grams[by[:-1]])
            second = np.full(len(at), -1, np.int64)
            second[by[follows[::-1]]] = own[by[follows[::-1] + 1]]
            place = np.where(itself, second, place)
        text = np.searchsorted(words.first, at, "right")
        joins = known[1:] & known[:-1] & (block[1:] == block[:-1]) & (place[1:] - own[1:] == place[:-1] - own[:-1]) & (text[1:] == text[:-1]) & (np.diff(at) <= self.phrase)
        heads = np.flatnonzero(np.concatenate([[True], ~joins]))
        tails = np.concatenate([heads[1:], [len(at)]]) - 1
        starts, ends = at[heads], at[tails] + self.phrase
        long = known[heads] & (ends - starts >= self.window)
        starts, ends = starts[long], ends[long]
        position = np.flatnonzero(valid)
        if len(starts):
            factor = np.searchsorted(starts, position, "right") - 1
            settled[position] = (factor >= 0) & (ends[np.maximum(factor, 0)] >= position + self.window)
        shared = known[np.searchsorted(at, chosen[position])]
        open_[position] = shared & ~settled[position]
        return settled, open_


def tell_phrases(table: pa.Table) -> pa.Table:
    """For each block its phrases that also occur elsewhere, with one other place."""
    hashes, blocks, places, several, sizes = _entries(table)
    order = np.lexsort((places, blocks, hashes))
    hashes, blocks, places, several = hashes[order], blocks[order], places[order], several[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    lengths = np.diff(np.concatenate([heads, [len(hashes)]]))
    head = np.repeat(heads, lengths)
    shared = (np.repeat(lengths, lengths) > 1) | several
    other = head.copy()
    first = (np.arange(len(hashes)) == head) & (np.repeat(lengths, lengths) > 1)
    other[first] += 1
    return _told(PHRASE, hashes[shared], blocks[shared], blocks[other[shared]], places[other[shared]])


def tell_contested(phrases: pa.Table, open_: pa.Table) -> pa.Table:
    """For each block its phrases that some block could not settle."""
    hashes, blocks, _, _, _ = _entries(phrases)
    wanted = np.isin(hashes, B.joined(open_["hashes"], np.uint64)[0]) if open_.num_rows else np.zeros(len(hashes), bool)
    none = np.zeros(int(wanted.sum()), np.int32)
    return _told(CONTESTED, hashes[wanted], blocks[wanted], none, none)


def tell_windows(table: pa.Table) -> pa.Table:
    """For each block its windows that also occur elsewhere."""
    hashes, blocks, _, several, _ = _entries(table)
    order = np.argsort(hashes, kind="stable")
    hashes, blocks, several = hashes[order], blocks[order], several[order]
    same = hashes[1:] == hashes[:-1]
    shared = several | np.concatenate([same, [False]]) | np.concatenate([[False], same])
    none = np.zeros(int(shared.sum()), np.int32)
    return _told(WINDOW, hashes[shared], blocks[shared], none, none)


def _entries(table: pa.Table):
    hashes, sizes = B.joined(table["hashes"], np.uint64)
    blocks = np.repeat(table["block"].to_numpy(), sizes)
    return hashes, blocks, B.joined(table["places"], np.uint32)[0], B.joined(table["several"], bool)[0], sizes


def _told(kind: int, hashes, blocks, ref_blocks, ref_places) -> pa.Table:
    order = np.argsort(blocks, kind="stable")
    hashes, blocks, ref_blocks, ref_places = hashes[order], blocks[order], ref_blocks[order], ref_places[order]
    to, begun = np.unique(blocks, return_index=True)
    parts = [slice(a, b) for a, b in zip(begun, np.append(begun, len(blocks))[1:], strict=True)]
    some = kind == PHRASE
    return pa.table(
        {
            "block": pa.array(to, pa.int32()),
            "kind": pa.array(np.full(len(to), kind), pa.int32()),
            "hashes": pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
            "blocks": pa.array([ref_blocks[p].astype(np.int32).tobytes() if some else b"" for p in parts], pa.binary()),
            "places": pa.array([ref_places[p].astype(np.uint32).tobytes() if some else b"" for p in parts], pa.binary()),
        }
    )


def _places(words: Words, at: np.ndarray) -> np.ndarray:
    """Word positions with a gap between texts, so that no factor runs over a text's end."""
    return at + np.searchsorted(words.first, at, "right")


def _spans(gone: np.ndarray, first: np.ndarray) -> pa.Array:
    edge = np.zeros(len(gone), bool)
    if len(gone):
        edge[first[:-1][first[:-1] < len(gone)]] = True
    begin = gone & (edge | ~np.concatenate([[False], gone[:-1]]))
    last = gone & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([gone[1:], [False]]))
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    text = np.searchsorted(first, starts, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(starts - first[text], pa.int64()), pa.array(ends - first[text], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(first))), pa.int32()), spans)
