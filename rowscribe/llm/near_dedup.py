"""Near duplicates by order MinHash.

Texts of equal words are one node. A node's sketches each hold the two
occurrence-labelled two-word shingles of least hash, in the order of the text,
so they agree for texts that an alignment, not only a set of shingles, calls
alike. An edit kills two shingles: if every fifth word is edited, three of five
shingles survive, a sketch agrees in about 0.18 of the cases and one of
``SKETCHES`` practically always. Nodes with an equal sketch form a bucket. Pairs of fitting lengths are verified by a banded alignment of their
words in three rounds: the likeliest of the pairs of a node with its buckets'
least nodes, the rest of these, and then all pairs of a bucket that
are still in two classes and were not compared. A group of near copies is one
class by then, so only unlike texts that share a bucket cost pairs of their own.
Classes are the connected components of verified pairs.

Buckets are summed before they are shuffled, and hot ones are split by the joins.
A text is moved only if a bitmap of the nodes in pairs may hold it, its word
hashes only if it is in a pair whose counts of words by hash allow an alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.llm.words import ALPHANUMERIC, FOLD_CASE, SLICE, mix, pieces, windows, words_of
from rowscribe.session import cut

SHINGLE = 2
SKETCHES = 64
ALIKE = 0.8
#: Of the bitmap of needed nodes (8 MB); a text that is not needed passes as often as a bit of it is set.
BITS = 1 << 26
#: Words of a node are counted by the hash in so many bytes.
BINS = 256
#: Rows that the members of a class in a bucket are dealt over.
LISTS = 8
_SEEDS = np.random.default_rng(97).integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) for every row.

    Two texts are linked if the edit distance of their words (runs of digits,
    letters and non-ASCII characters, A-Z like a-z) is at most a fifth of the
    longer one's words. Null and wordless texts are all equal. A text of one word
    is one shingle. A row without doc_id has no class of its own:
    it gets that of other rows with the same words, else null. Repeated rows are
    one class. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.mapInArrow(_sketches, "doc_id long, node long, n int, bag binary, sketches array<long>"), "sketches")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bag").alias("bag"), F.min("sketches").alias("sketches")), "nodes")
    shared = _shared(nodes)
    pairs = _pairs(shared, nodes)
    # Each node is first aligned with the one it shares most buckets with; pairs that are then in one class need no look.
    most = pairs.groupBy("node").agg(F.max(F.struct("shared", "other")).alias("best")).select("node", F.col("best.other").alias("other"))
    first = cut(_ordered(most), "pairs")
    links = _verified(texts, nodes, first)
    roots = components(links)
    apart = _ordered(pairs).join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
    apart = apart.join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    rest = cut(apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "pairs")
    links = cut(links.unionByName(_verified(texts, nodes, rest)), "links")
    found = components(links)
    left = cut(_left(shared, nodes, found).join(first.unionByName(rest), ["a", "b"], "left_anti"), "pairs")
    if not left.isEmpty():
        found = components(links.unionByName(_verified(texts, nodes, left)))
    members = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = members.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = members.select("node", "root").join(least, "root").select("node", "class_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "class_id")


def _sketches(batches):
    for batch in pieces(batches, limit=SLICE):
        words = words_of(batch.column("text"), ALPHANUMERIC, FOLD_CASE)
        counts = np.diff(words.first)
        whole = _whole(words)
        grams = windows(words.hashes, SHINGLE)
        text = np.repeat(np.arange(batch.num_rows), counts)[: len(grams)]
        keep = np.arange(len(grams)) + SHINGLE <= words.first[1:][text]
        grams, text = grams[keep], text[keep]
        # Texts of fewer words have themselves as one shingle.
        short = np.flatnonzero(counts < SHINGLE)
        grams, text = np.concatenate([grams, whole[short]]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        grams, text = grams[order], text[order]
        labelled = mix(grams + _occurrence(grams, text) * np.uint64(0x9E3779B97F4A7C15))
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(text)]]))
        sketches = np.empty((batch.num_rows, SKETCHES), np.uint64)
        for i, seed in enumerate(_SEEDS):
            order = labelled * seed
            first = _least(order, heads, sizes)
            order[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            second = np.where(sizes > 1, _least(order, heads, sizes), first)
            low, high = np.minimum(first, second), np.maximum(first, second)
            sketches[:, i] = mix(grams[low] * np.uint64(3) + mix(grams[high]) + seed)
        flat = pa.array(sketches.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * SKETCHES, pa.int32()), flat)
        bags = pa.array([bag.tobytes() for bag in _bags(words)], pa.binary())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "node": whole.view(np.int64), "n": counts.astype(np.int32), "bag": bags, "sketches": lists})


def _bags(words) -> np.ndarray:
    """Each text's words counted by hash, as ``_spell`` counts them."""
    texts = len(words.first) - 1
    at = np.repeat(np.arange(texts) * BINS, np.diff(words.first)) + ((words.hashes >> np.uint64(32)) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=texts * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def _whole(words) -> np.ndarray:
    """A hash of each text's sequence of words."""
    n = len(words.hashes)
    place = np.arange(n) - np.repeat(words.first[:-1], np.diff(words.first))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hashes + mix(place.astype(np.uint64))))])
    return mix(total[words.first[1:]] - total[words.first[:-1]] + np.diff(words.first).astype(np.uint64))


def _occurrence(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many equal shingles stand before each one in its text."""
    order = np.lexsort((grams, text))
    g, t = grams[order], text[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])])
    heads = np.flatnonzero(new)
    out = np.empty(len(grams), np.uint64)
    out[order] = np.arange(len(g)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(g)]])))
    return out


def _least(values: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the least value of each run stands, the first of equal ones."""
    least = np.minimum.reduceat(values, heads)
    at = np.flatnonzero(values == np.repeat(least, sizes))
    return at[np.searchsorted(at, heads)]


def _shared(nodes: DataFrame) -> DataFrame:
    """bucket, node, n and least (the least node) of every bucket of two nodes or more."""
    keys = nodes.select("node", "n", F.explode(F.transform("sketches", lambda s, i: F.xxhash64(i, s))).alias("bucket"))
    # Plain numbers are summed by hash; a least struct would sort all keys.
    ends = keys.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("greatest"))
    return cut(keys.join(ends.filter("least != greatest").select("bucket", "least"), "bucket"), "shared")


def _fits(n, m):
    """Whether texts of so many words can be alike."""
    return F.least(n, m) >= ALIKE * F.greatest(n, m) - 1e-9


def _pairs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, other (the least node of a bucket of both) and how many such buckets they share."""
    counted = shared.filter("node != least").groupBy("node", "n", F.col("least").alias("other")).agg(F.count("*").alias("shared"))
    sized = counted.join(nodes.select(F.col("node").alias("other"), F.col("n").alias("m")), "other")
    return cut(sized.filter(_fits("n", "m")).select("node", "other", "shared"), "pairs")


def _left(shared: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of fitting lengths and words of all buckets, without those of one class.

    The members of a class in a bucket are ``LISTS`` rows at most until classes have met, so the
    pairs inside a class are never formed. Members bring the counts of their words along: a pair
    that these rule out is dropped where it is formed, and never moved.
    """
    # Lengths that fit are in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1.01 / ALIKE))).cast("int")
    placed = shared.filter("n > 0").select("bucket", "node", "n", band.alias("band")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    placed = placed.join(mixed, "bucket").join(nodes.select("node", "bag"), "node")
    part = F.pmod(F.xxhash64("node"), F.lit(LISTS)).alias("list")
    sides = placed.groupBy("bucket", "band", "root", part).agg(F.collect_list(F.struct("n", "node", "bag")).alias("members"))
    sides = cut(sides.drop("list"), "sides")
    shorter = sides.select("bucket", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("root").alias("root_s"), F.col("members").alias("shorter"))
    longer = sides.select("bucket", "band", F.col("root").alias("root_l"), F.col("members").alias("longer"))
    met = shorter.join(longer, ["bucket", "band"]).filter("root_s != root_l").select(F.explode("shorter").alias("s"), "longer").select("s", F.explode("longer").alias("l"))
    met = met.filter((F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.node") < F.col("l.node")))).filter(_fits("s.n", "l.n"))
    of = lambda side, to: [F.col(f"{side}.{c}").alias(f"{name}{to}") for c, name in (("node", ""), ("n", "n_"), ("bag", "bag_"))]
    likely = met.select(*of("s", "a"), *of("l", "b")).mapInArrow(_likely, "a long, b long")
    return _ordered(likely.select(F.col("a").alias("node"), F.col("b").alias("other")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a < b)."""
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose words align."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    one = cut(nodes.select("node", "doc_id").filter("doc_id IS NOT NULL").join(needed, "node"), "needed")
    spelled = cut(_needed(texts, one).join(one, "doc_id").select("node", "text").mapInArrow(_spell, "node long, n int, bag binary, words binary").dropDuplicates(["node"]), "spelled")
    # Every pair carries its words, so first those go whose words are too unlike in any order.
    bags = pairs
    for side in "ab":
        bags = bags.join(spelled.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bag").alias(f"bag_{side}")), side)
    pairs = cut(bags.mapInArrow(_likely, "a long, b long"), "likely")
    left = pairs.join(spelled.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
    both = left.join(spelled.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    return cut(both.select("a", "b", "words_a", "words_b").mapInArrow(_aligned, "a long, b long"), "links")


def _needed(texts: DataFrame, one: DataFrame) -> DataFrame:
    """The texts of the doc_ids of ``one``, and a few others; found in place, by a bitmap of hashes of bounded size."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1
    page, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    bitmap = one.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("bits"))
    octet = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = texts.join(F.broadcast(bitmap), page == F.col("page"))
    return held.filter(F.getbit(octet, (at % 8).cast("int")) == 1).select(texts.columns)


def _spell(batches):
    for batch in pieces(batches):
        words = words_of(batch.column("text"), ALPHANUMERIC, FOLD_CASE)
        # A doc_id may stand for several texts; only the node's own counts.
        own = np.flatnonzero(_whole(words).view(np.int64) == batch.column("node").to_numpy())
        small = (words.hashes >> np.uint64(32)).astype(np.uint32)
        spelled = [small[words.first[i] : words.first[i + 1]] for i in own]
        bags = [np.minimum(np.bincount(x % BINS, minlength=BINS), 255).astype(np.uint8).tobytes() for x in spelled]
        counts = pa.array([len(x) for x in spelled], pa.int32())
        yield pa.record_batch({"node": batch.column("node").take(pa.array(own)), "n": counts, "bag": pa.array(bags, pa.binary()), "words": pa.array([x.tobytes() for x in spelled], pa.binary())})


def _likely(batches):
    """The pairs that the counts of their words leave possible; every edit takes one word away and brings one at most."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int32) for c in ("bag_a", "bag_b"))
        limit = ((1 - ALIKE) * np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) + 1e-9).astype(np.int64)
        excess = a - b
        keep = np.maximum(np.maximum(excess, 0).sum(axis=1), np.maximum(-excess, 0).sum(axis=1)) <= limit
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _aligned(batches):
    for batch in batches:
        keep = [alike(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(batch.column("words_a"), batch.column("words_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def alike(a: np.ndarray, b: np.ndarray, share: float = ALIKE) -> bool:
    """Whether the edit distance is at most (1 - share) of the longer length; the band grows only as far as needed."""
    limit = int((1 - share) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if len(a) == len(b) and int((a != b).sum()) <= limit:
        return True
    # Every edit takes one word away and brings one at most.
    excess = np.bincount(a & np.uint32(1023), minlength=1024) - np.bincount(b & np.uint32(1023), minlength=1024)
    if max(excess[excess > 0].sum(), -excess[excess < 0].sum()) > limit:
        return False
    same = min(len(a), len(b))
    head = int((np.append(a[:same] != b[:same], True)).argmax())
    a, b = a[head:], b[head:]
    same = min(len(a), len(b))
    tail = int((np.append(a[::-1][:same] != b[::-1][:same], True)).argmax())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= limit:
        return True
    band = max(8, len(a) - len(b))
    while band < limit:
        if band_distance(a, b, band) <= band:
            return True
        band *= 4
    return band_distance(a, b, limit) <= limit


def band_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance if it is at most ``band``, else something larger; a bit per cell of a row of the band.

    ``a`` is the longer one and longer than ``band``, by which it may exceed ``b``.
    """
    width = 2 * band + 2
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | (1 << i)
    top, below = 1 << (width - 1), 1 << (width - 2)
    plus, minus, distance = (full << (width - band - 1)) & full, 0, band
    start = band + 1 - width
    diagonal = len(a) - band
    for i, word in enumerate(b.tolist()):
        bits = where.get(word, 0)
        hit = ((bits >> start) if start >= 0 else (bits << -start)) & full
        zero = ((((hit & plus) + plus) ^ plus) | hit | minus) & full
        up = minus | (~(zero | plus) & full)
        down = zero & plus
        if i < diagonal:
            distance += not zero & top
        else:
            distance += bool(up & below) - bool(down & below)
            below >>= 1
        if distance > 2 * band + len(b) - len(a) + band:
            return band + 1
        half = zero >> 1
        plus = (down | ~(half | up)) & full
        minus = half & up
        start += 1
    return distance


def components(links: DataFrame) -> DataFrame:
    """node and root (least node) of every node in ``links`` (a, b).

    Every round each node takes the least root of its neighbours and then its
    root's root; rounds grow with the logarithm of a component's diameter.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        # A root learns what its members have found.
        heard = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        hooked = heard.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("hook"))
        lower = cut(heard.join(hooked, "node", "left").select("node", "root", F.least("new", F.coalesce("hook", "new")).alias("new")), "roots")
        jumped = lower.join(lower.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left")
        after = cut(jumped.select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")), "roots")
        done = after.filter("old != root").isEmpty()
        roots = after.select("node", "root")
        if done:
            return roots
