"""Jaccard self-join of word shingles, filtered by several global token orders.

If two sets are alike, then under any one global order of the tokens their
prefixes share a token. The join asks this of three orders and keeps a pair only
if it holds for all of them:

1. *by hash.* Prefixes are lengthened by a fifth of the set, so alike sets share
   that many tokens of them, not one. Every text's prefix is dealt to buckets,
   which count for each set how many of its tokens another set has. Most texts
   end here: a passage they share with others is too small a part of them.
2. *by frequency* among the sets left, rarest first, ties by hash. Tokens of one
   set alone lie first, so its prefix holds shared tokens only if nearly the whole
   set is shared. Posting lists of this order give the candidates.
3. *by frequency, ties by another hash*, and order 1 again, on the candidates.

Equal sets are one node. A node's home is the least node it shares a prefix token
with, so a group of near copies has few homes. Homes that meet in a posting list
are compared in chunks of a bounded number of sets and tokens: the prefixes of
each order are intersected, what is left is verified by exact intersection sizes
(a product of two incidence matrices). A pair of chunks gives back a spanning
forest of its links, so a group of a million near copies never becomes a million
squared rows.

Texts are hashed where they are read; only texts that pass order 1 are moved.
Equality is that of 64-bit hashes. One text must fit into a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.llm import blocks as B
from rowscribe.llm.near_dedup import components
from rowscribe.llm.words import FOLD_CASE, NOT_SPACE, inside_texts, mix, pieces, windows, words_of
from rowscribe.session import cut

SHINGLE = 5
#: Least intersection of linked sets, in hundredths of their union.
PERCENT = 80
#: Text of a bucket and of a block, in bytes (a task holds about 18 times a block's); tokens a task gathers before it sends them.
BUCKET_BYTES, BLOCK_BYTES, GATHERED = 16 << 20, 4 << 20, 1 << 20
#: Sets and tokens of a chunk that is compared at once (a longer set is a chunk of its own).
CHUNK_SETS, CHUNK_TOKENS = 96, 1 << 18
#: Distinct tokens in a slice of the incidence matrices.
SLICE = 4096
_TIES = np.random.default_rng(13).integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ASKED = "bucket int, nodes binary, sizes binary, tokens binary, several binary, told_nodes binary, told_counts binary"
TOLD = "part int, nodes binary, counts binary"


def linked_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row.

    A set holds the distinct shingles of five words (runs of characters other than
    space and tab to carriage return, A-Z like a-z), or the whole sequence of fewer
    words. Two rows link if 100 times the intersection is at least ``percent`` times
    the union. A null, empty or wordless text has 0 shingles and is its own
    component. Repeated rows and equal sets link. A row without doc_id takes part;
    it does not name a component: its component_id is null if no row of the component
    has a doc_id. Other columns are not read. An empty table gives an empty table.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = cut(texts.mapInArrow(_sizes, "doc_id long, text_key long, node long, n_shingles long"), "sets")
    sets = rows.filter("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n_shingles").alias("n_shingles")
    )
    named = cut(sets, "nodes")
    links = _links(texts, named, percent)
    found = components(links)
    members = named.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = members.select("node", "root").join(least, "root").select("node", "component_id")
    filled = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "node").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return filled.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _links(texts: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes whose links connect every component."""
    left = cut(_by_hash(texts, named, percent), "left")
    sets = cut(_by_frequency(texts, left, percent), "prefixes")
    return cut(_verified(sets, percent), "links")


class Sets:
    """The shingle sets of the texts of a column: tokens ascending by hash, text after text."""

    def __init__(self, column: pa.Array):
        words = words_of(column, NOT_SPACE, FOLD_CASE)
        counts = np.diff(words.first)
        grams = windows(words.hashes, SHINGLE)
        inside = inside_texts(words.first, len(grams), SHINGLE)
        total = np.concatenate([[0], np.cumsum(inside)])
        bounds = total[np.minimum(words.first, len(grams))]
        grams = grams[inside]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            grams[low:high].sort()
        text = np.repeat(np.arange(len(counts)), np.diff(bounds))
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
        # A text of fewer words is one token: that of its word sequence.
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        tokens, text = np.concatenate([grams[new], _sequences(words, short)]), np.concatenate([text[new], short])
        order = np.argsort(text, kind="stable")
        self.tokens, self.text = tokens[order], text[order]
        self.sizes = np.bincount(self.text, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.tokens))])
        self.nodes = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(np.uint64))

    def ranks(self) -> np.ndarray:
        return np.arange(len(self.tokens)) - self.first[self.text]


def _sequences(words, texts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for step in range(SHINGLE - 1):
        at = words.first[texts] + step
        inside = at < words.first[texts + 1]
        out[inside] = mix(out[inside] * np.uint64(3) + words.hashes[at[inside]] + np.uint64(step + 1))
    return out


def prefix(sizes, percent: int):
    """Tokens of a set's prefix under any order: one more than an alike set may lack."""
    return sizes - (percent * sizes + 99) // 100 + 1


def _longer(sizes, percent: int):
    """Tokens by which a set's prefix of order 1 is lengthened."""
    return np.minimum(sizes, np.maximum(1, sizes // 5)) - 1


def _needed(sizes: Column, percent: int) -> Column:
    """Least number of prefix tokens of order 1 that an alike set has too, of that or the smallest fitting size."""
    return F.greatest(F.lit(1), F.floor(F.ceil(sizes * percent / 100) / 5))


def _sizes(batches):
    for batch in pieces(batches, limit=8 << 20):
        sets = Sets(batch.column("text"))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "node": sets.nodes.view(np.int64), "n_shingles": sets.sizes.astype(np.int64)})


# Order 1: by hash.


def _by_hash(texts: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """The nodes that have as many tokens in common with others as order 1 asks for."""
    size, count = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(1, math.ceil((size or 0) / BUCKET_BYTES))
    parts = max(min(buckets, 32), math.ceil(count / (1 << 20)))
    asked = texts.select("text").mapInArrow(lambda batches: _ask(batches, percent, buckets), ASKED)
    told = asked.groupBy("bucket").applyInArrow(lambda t: _tell(t, parts), TOLD)
    votes = told.groupBy("part").applyInArrow(_sum, "node long, shared long")
    return named.join(votes, "node").filter(F.col("shared") >= _needed(F.col("n_shingles"), percent)).select("node", "n_shingles", "one")


def _ask(batches, percent: int, buckets: int):
    """The prefixes of order 1, for each bucket the tokens of one node alone and those of several."""
    held, count, turn = [], 0, 0
    for batch in pieces(batches, limit=8 << 20):
        sets = Sets(batch.column("text"))
        chosen = sets.ranks() < (prefix(sets.sizes, percent) + _longer(sets.sizes, percent))[sets.text]
        held.append((sets.tokens[chosen], sets.nodes[sets.text[chosen]]))
        count += int(chosen.sum())
        if count >= GATHERED:
            yield _questions(held, buckets, turn)
            held, count, turn = [], 0, turn + 1
    if held:
        yield _questions(held, buckets, turn)


def _questions(held: list, buckets: int, turn: int) -> pa.RecordBatch:
    tokens, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
    names, who = np.unique(nodes, return_inverse=True)
    # Copies of a text count once.
    order = np.lexsort((who, tokens))
    tokens, who = tokens[order], who[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (who[1:] != who[:-1])
    tokens, who = tokens[new], who[new]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(tokens)))
    alone = np.repeat(times, times) == 1
    # What this task sees more than once it need not ask about.
    known = np.bincount(who[~alone], minlength=len(names))
    several = tokens[heads[times > 1]]
    several_owner = _owner(several, buckets)
    tokens, who = tokens[alone], who[alone]
    order = np.lexsort((who, _owner(tokens, buckets)))
    tokens, who = tokens[order], who[order]
    bounds = np.searchsorted(_owner(tokens, buckets), np.arange(buckets + 1))
    out = []
    for bucket in range(buckets):
        mine = who[bounds[bucket] : bounds[bucket + 1]]
        found, sizes = np.unique(mine, return_counts=True)
        own = several[several_owner == bucket] if len(several) else several
        tell = bucket == turn % buckets
        if len(mine) or len(own) or tell:
            told = known > 0
            out.append((bucket, names[found], sizes.astype(np.uint32), tokens[bounds[bucket] : bounds[bucket + 1]], own, names[told] if tell else names[:0], known[told].astype(np.uint32) if tell else sizes[:0].astype(np.uint32)))
    columns = ["nodes", "sizes", "tokens", "several", "told_nodes", "told_counts"]
    return pa.record_batch({"bucket": pa.array([x[0] for x in out], pa.int32())} | {c: pa.array([x[i + 1].tobytes() for x in out], pa.binary()) for i, c in enumerate(columns)})


def _owner(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(tokens) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _tell(table: pa.Table, parts: int) -> pa.Table:
    """For each node how many of its tokens another node has."""
    tokens, _ = B.joined(table["tokens"], np.uint64)
    nodes = np.repeat(B.joined(table["nodes"], np.uint64)[0], B.joined(table["sizes"], np.uint32)[0])
    several = np.unique(B.joined(table["several"], np.uint64)[0])
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[new], nodes[new]
    same = tokens[1:] == tokens[:-1]
    shared = np.concatenate([same, [False]])[: len(tokens)] | np.concatenate([[False], same])[: len(tokens)] | np.isin(tokens, several)
    found, counts = np.unique(nodes[shared], return_counts=True)
    found = np.concatenate([found, B.joined(table["told_nodes"], np.uint64)[0]])
    counts = np.concatenate([counts.astype(np.uint32), B.joined(table["told_counts"], np.uint32)[0]])
    part = found % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    found, counts, part = found[order], counts[order], part[order]
    to, begun = np.unique(part, return_index=True)
    slices = [slice(a, b) for a, b in zip(begun, np.append(begun, len(part))[1:], strict=True)]
    return pa.table({"part": pa.array(to.astype(np.int32)), "nodes": pa.array([found[s].tobytes() for s in slices], pa.binary()), "counts": pa.array([counts[s].tobytes() for s in slices], pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    nodes, at = np.unique(B.joined(table["nodes"], np.uint64)[0], return_inverse=True)
    counts = np.bincount(at, B.joined(table["counts"], np.uint32)[0].astype(float), len(nodes))
    return pa.table({"node": nodes.view(np.int64), "shared": counts.astype(np.int64)})


# Orders 2 and 3: by frequency.


def _by_frequency(texts: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """node, its tokens, and its prefixes under orders 2 and 3, of nodes with a shared token in both."""
    total = left.agg(F.sum("n_shingles").alias("n")).first().n or 0
    # A token is about six bytes of text.
    count = max(1, math.ceil(total * 6 / BLOCK_BYTES))
    keys = left.select("node", F.col("one.doc_id").alias("one_id"), F.col("one.text_key").alias("one_key"))
    same = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key"))
    # The sets left grow with the texts, so they meet them by a shuffle at any size.
    placed = cut(texts.join(keys.hint("merge"), same).select(F.pmod("node", F.lit(count)).cast("int").alias("block"), "node", "text"), "texts")
    asked = placed.groupBy("block").applyInArrow(lambda t: _ask_frequency(t, count), "bucket int, block int, hashes binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(_tell_frequency, "block int, hashes binary, counts binary")
    kind = "node long, n int, tokens binary, second array<long>, third binary"
    return placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, u: _prefixes(t, u, percent), kind)


def _block(table: pa.Table) -> tuple[Sets, np.ndarray]:
    """The sets of a block, each node once."""
    _, at = np.unique(table["node"].to_numpy(), return_index=True)
    table = table.combine_chunks().take(pa.array(at))
    return Sets(table["text"]), table["node"].to_numpy().view(np.uint64)


def _ask_frequency(table: pa.Table, buckets: int) -> pa.Table:
    sets, _ = _block(table)
    tokens, counts = np.unique(sets.tokens, return_counts=True)
    rows = [(b, tokens[s].tobytes(), counts[s].astype(np.uint32).tobytes()) for b, s in B.bucket_slices(tokens, buckets)]
    block = table["block"][0].as_py()
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})


def _tell_frequency(table: pa.Table) -> pa.Table:
    """For each block the tokens of its sets that two sets or more hold, and of how many."""
    hashes, sizes = B.joined(table["hashes"], np.uint64)
    blocks = np.repeat(np.arange(table.num_rows), sizes)
    _, at = np.unique(hashes, return_inverse=True)
    counts = np.bincount(at, B.joined(table["counts"], np.uint32)[0])[at] if len(hashes) else np.zeros(0)
    shared = counts > 1
    bounds = np.searchsorted(blocks[shared], np.arange(table.num_rows + 1))
    hashes, counts = hashes[shared], counts[shared].astype(np.uint32)
    parts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table({"block": table["block"].combine_chunks(), "hashes": pa.array([hashes[p].tobytes() for p in parts], pa.binary()), "counts": pa.array([counts[p].tobytes() for p in parts], pa.binary())})


def _prefixes(table: pa.Table, told: pa.Table, percent: int) -> pa.Table:
    kinds = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("second", pa.list_(pa.int64())), ("third", pa.binary())])
    if not table.num_rows:
        return kinds.empty_table()
    sets, nodes = _block(table)
    known, _ = B.joined(told["hashes"], np.uint64) if told.num_rows else (np.zeros(0, np.uint64), None)
    counts, _ = B.joined(told["counts"], np.uint32) if told.num_rows else (np.zeros(0, np.uint32), None)
    order = np.argsort(known)
    known, counts = np.append(known[order], np.uint64(0)), np.append(counts[order], np.uint32(1))
    slot = np.searchsorted(known[:-1], sets.tokens)
    often = np.where(known[slot] == sets.tokens, counts[slot], 1)
    limit = prefix(sets.sizes, percent)[sets.text]
    held = []
    for tie in _TIES:
        order = np.lexsort((mix(sets.tokens ^ tie), often, sets.text))
        shared = (sets.ranks() < limit) & (often[order] > 1)
        held.append((sets.tokens[order][shared], np.searchsorted(sets.text[shared], np.arange(len(nodes) + 1))))
    (second, at), (third, to) = held
    keep = np.flatnonzero((np.diff(at) > 0) & (np.diff(to) > 0))
    return pa.table(
        [
            pa.array(nodes[keep].view(np.int64)),
            pa.array(sets.sizes[keep].astype(np.int32)),
            pa.array([sets.tokens[sets.first[i] : sets.first[i + 1]].tobytes() for i in keep], pa.binary()),
            pa.array([second[at[i] : at[i + 1]].view(np.int64) for i in keep], pa.list_(pa.int64())),
            pa.array([third[to[i] : to[i + 1]].tobytes() for i in keep], pa.binary()),
        ],
        schema=kinds,
    )


# Candidates and their verification.


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links of every two chunks that may hold some."""
    lists = sets.select("node", "n", F.explode("second").alias("token"))
    ends = lists.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    met = cut(lists.join(ends.filter("low != high"), "token").select("token", "node", "low"), "lists")
    homes = met.groupBy("node").agg(F.min("low").alias("home"))
    sized = homes.join(sets, "node")
    cells = sized.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n") / CHUNK_TOKENS)).cast("int").alias("chunks"), F.count("*").alias("n_sets"))
    cells = cut(cells, "cells")
    # Homes that meet in a list; most lists have one.
    listed = met.join(homes, "node").groupBy("token", "home").agg(F.lit(1).alias("one")).drop("one")
    mixed = listed.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high")).filter("low != high").select("token")
    several = cut(listed.join(mixed, "token"), "several")
    apart = several.select("token", F.col("home").alias("home_a")).join(several.select("token", F.col("home").alias("home_b")), "token").filter("home_a < home_b").select("home_a", "home_b").distinct()
    within = cells.filter("n_sets > 1").select(F.col("home").alias("home_a"), F.col("home").alias("home_b"))
    asked = apart.unionByName(within)
    for side in "ab":
        asked = asked.join(cells.select(F.col("home").alias(f"home_{side}"), F.col("chunks").alias(f"chunks_{side}")), f"home_{side}")
    asked = asked.select("home_a", "home_b", "chunks_b", F.explode(F.sequence(F.lit(0), F.col("chunks_a") - 1)).alias("chunk_a"))
    first = F.when(F.col("home_a") == F.col("home_b"), F.col("chunk_a")).otherwise(0)
    asked = asked.select("home_a", "chunk_a", "home_b", F.explode(F.sequence(first, F.col("chunks_b") - 1)).alias("chunk_b"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    member = F.struct("node", "n", "tokens", F.transform("second", lambda x: x).alias("second"), "third")
    packed = cut(sized.join(cells, "home").select("home", chunk, member.alias("member")).groupBy("home", "chunk").agg(F.collect_list("member").alias("members")), "chunks")
    for side in "ab":
        asked = asked.join(packed.select(F.col("home").alias(f"home_{side}"), F.col("chunk").alias(f"chunk_{side}"), F.col("members").alias(f"members_{side}")), [f"home_{side}", f"chunk_{side}"])
    twin = (F.col("home_a") == F.col("home_b")) & (F.col("chunk_a") == F.col("chunk_b"))
    return asked.select(twin.alias("twin"), "members_a", "members_b").mapInArrow(lambda batches: _compare(batches, percent), "a long, b long")


def _compare(batches, percent: int):
    for batch in batches:
        for i in range(batch.num_rows):
            a = Members(batch.column("members_a")[i].values, percent)
            b = a if batch.column("twin")[i].as_py() else Members(batch.column("members_b")[i].values, percent)
            yield _forest(a, b, percent)


class Members:
    """The sets of a chunk: for whole sets and each order's prefix the tokens and whose they are."""

    def __init__(self, members: pa.StructArray, percent: int):
        self.nodes, self.n = members.field("node").to_numpy(), members.field("n").to_numpy()
        self.whole = _packed(members.field("tokens"))
        second = members.field("second")
        self.second = (second.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(second)), np.diff(second.offsets.to_numpy())))
        self.third = _packed(members.field("third"))
        tokens, who = self.whole
        inside = np.arange(len(tokens)) - np.searchsorted(who, who) < prefix(self.n, percent)[who]
        self.first = (tokens[inside], who[inside])

    def only(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens, who = self.whole
        inside = rows[who]
        return tokens[inside], who[inside]


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def shared(a: tuple, b: tuple, shape: tuple) -> np.ndarray:
    """Intersection size of each set of ``a`` with each of ``b``, in slices of the tokens both know."""
    out = np.zeros(shape, np.float32)
    both = np.intersect1d(a[0], b[0])
    if not len(both):
        return out
    columns = []
    for tokens, who in (a, b):
        slot = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        known = both[slot] == tokens
        order = np.argsort(slot[known], kind="stable")
        columns.append((slot[known][order], who[known][order]))
    for low in range(0, len(both), SLICE):
        sides = []
        for (slot, who), n in zip(columns, shape, strict=True):
            s = slice(*np.searchsorted(slot, [low, low + SLICE]))
            side = np.zeros((n, min(SLICE, len(both) - low)), np.float32)
            side[who[s], slot[s] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _forest(a: Members, b: Members, percent: int) -> pa.RecordBatch:
    shape = (len(a.nodes), len(b.nodes))
    low, high = np.minimum(a.n[:, None], b.n[None]), np.maximum(a.n[:, None], b.n[None])
    may = (100 * low.astype(np.int64) >= percent * high.astype(np.int64)) & (a.nodes[:, None] != b.nodes[None])
    if a is b:
        may &= np.tri(*shape, dtype=bool)
    for order in ("second", "third", "first"):
        if not may.any():
            break
        may &= shared(getattr(a, order), getattr(b, order), shape) > 0
    x, y = np.nonzero(may)
    if len(x):
        # Only sets with a candidate are compared whole. Sizes below 2**24 are exact.
        sizes = shared(a.only(may.any(axis=1)), b.only(may.any(axis=0)), shape)[x, y].astype(np.int64)
        good = 100 * sizes >= percent * (a.n[x].astype(np.int64) + b.n[y] - sizes)
        x, y = x[good], y[good]
    parents: dict[int, int] = {}

    def root(node: int) -> int:
        while parents.setdefault(node, node) != node:
            parents[node] = parents[parents[node]]
            node = parents[node]
        return node

    out = []
    for one, other in zip(a.nodes[x].tolist(), b.nodes[y].tolist(), strict=True):
        r, s = root(one), root(other)
        if r != s:
            parents[max(r, s)] = min(r, s)
            out.append((one, other))
    return pa.record_batch({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})
