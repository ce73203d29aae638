"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. Their words are weighed by inverse
document frequency over all documents, and a randomised subspace iteration,
whose products are computed by Spark tasks over the passages, gives the latent
space. Every passage of every document is folded into that space and compared by
cosine (latent product over full lengths, relative to that of the item passage
with itself) with all item passages. Candidates that
share half their words with the item are then read word by word: the longest
common subsequence of item and surroundings must hold ``ALIKE`` of the item, and
that of its answer (its last third) ``ANSWER`` of it. So word swaps, insertions
and deletions are found, and passages that only share vocabulary are not.

The benchmark is the stated query set: it goes to the tasks in blocks of
``ITEMS`` items, and each block is compared with all documents. Documents are
never shuffled; words counted for the weights are summed in each batch first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.llm.words import ALPHANUMERIC, FOLD_CASE, inside_texts, pieces, windows, words_of

ITEMS = 1_000
#: Words of an item that are compared; a longer item is several items, each of this length; the last two may overlap.
ITEM_WORDS = 256
PASSAGE, STEP = 32, 16
RANK = 96
ROUNDS = 3
COSINE = 0.5
#: Share of a passage's words that an item must have before its words are read in order.
SHARED = 0.6
ALIKE, ANSWER = 0.6, 0.5
#: Items of fewer words must occur as they are.
SHORT = 10
#: Items of fewer words are also compared with passages of half the length.
BRIEF = 24
FOUND = "doc_id long, item_id long, start_word long, cosine double, similarity double, answer double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and figures of the best place, for each document and item it holds.

    Words are runs of digits, letters and non-ASCII characters, A-Z like a-z.
    Null and wordless texts and items hold nothing and are held by nothing; null
    ids stay null. Rows that repeat doc_id or item_id give one row for the pair,
    with the best figures. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        rows = _block(texts, part)
        found = rows if found is None else found.unionByName(rows)
    figures = F.struct("similarity", "answer", "cosine", (-F.col("start_word")).alias("start"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(figures).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.start")).alias("start_word"), *(F.col(f"best.{c}").alias(c) for c in ("cosine", "similarity", "answer")))


def _block(texts: DataFrame, part: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    rows = part.toArrow()  # a block of the stated query set
    items = Items(rows["item_id"].to_pylist(), rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    if not len(items.vocabulary):
        return spark.createDataFrame([], FOUND)
    counted = texts.mapInArrow(lambda b: items.count(b), "word int, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).collect()
    total = texts.count()
    seen = np.zeros(len(items.vocabulary))
    for r in counted:
        seen[r.word] = r.texts
    items.weights = np.log((total + 1.0) / (seen + 1.0)) + 0.05
    items.basis = latent_basis(spark, items)
    return texts.mapInArrow(lambda b: items.find(b), FOUND)


def latent_basis(spark, items: Items) -> np.ndarray:
    """Leading right singular vectors of the items' TF-IDF passages (words x rank).

    The passages are rows of a table; every round each task multiplies its rows
    A into A'(A Q), and the sums over tasks, as large as the block's vocabulary,
    become the next Q.
    """
    passages = spark.createDataFrame(pa.table({"passage": pa.array(np.arange(len(items.passages))), "words": pa.array(items.passages, pa.list_(pa.int32()))}))
    passages = passages.repartition(max(1, len(items.passages) // 2000 + 1))
    words, rank = len(items.vocabulary), min(RANK, len(items.vocabulary), len(items.passages))
    basis = np.random.default_rng(5).standard_normal((words, rank))
    weights = items.weights
    for _ in range(ROUNDS):
        q = np.linalg.qr(basis)[0]
        rows = passages.mapInArrow(lambda b, q=q: _multiply(b, q, weights), "word int, axis int, value double")
        sums = rows.groupBy("word", "axis").agg(F.sum("value").alias("value")).toArrow()
        basis = np.zeros((words, rank))
        basis[sums["word"].to_numpy(), sums["axis"].to_numpy()] = sums["value"].to_numpy()
    return np.linalg.qr(basis)[0].astype(np.float32)


def _multiply(batches, q: np.ndarray, weights: np.ndarray):
    total, used = np.zeros(q.shape), np.zeros(len(q), bool)
    for batch in batches:
        for words in batch.column("words").to_pylist():
            ids, times = np.unique(words, return_counts=True)
            value = times * weights[ids]
            value = value / max(np.linalg.norm(value), 1e-12)
            total[ids] += value[:, None] * (value @ q[ids])[None, :]
            used[ids] = True
    ids = np.flatnonzero(used)
    rank = q.shape[1]
    yield pa.record_batch({"word": np.repeat(ids, rank).astype(np.int32), "axis": np.tile(np.arange(rank), len(ids)).astype(np.int32), "value": total[ids].ravel()})


class Items:
    """A block of benchmark items: their words as places in the block's vocabulary, and their passages."""

    def __init__(self, names: list, texts: pa.Array):
        words = words_of(texts, ALPHANUMERIC, FOLD_CASE)
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        self.names, self.words = [], []
        for i, name in enumerate(names):
            own = ids[words.first[i] : words.first[i + 1]].astype(np.int32)
            for at in range(0, len(own), ITEM_WORDS):
                # The last piece reaches back to full length: a few words alone would be found anywhere.
                at = max(0, min(at, len(own) - ITEM_WORDS))
                self.names.append(name)
                self.words.append(own[at : at + ITEM_WORDS])
        self.passages, self.owner = [], []
        for i, own in enumerate(self.words):
            for at in range(0, max(1, len(own) - PASSAGE + STEP), STEP):
                self.passages.append(own[at : at + PASSAGE])
                self.owner.append(i)
        self.owner = np.array(self.owner, np.int64)
        sizes = np.array([len(self.words[i]) for i in self.owner], np.int64)
        self.brief, self.tiny = np.flatnonzero(sizes < BRIEF), np.flatnonzero(sizes < SHORT)
        self.tiny_hashes = {n: windows(words.hashes, n) for n in set(sizes[self.tiny].tolist()) - {0}}
        self.tiny_at = {n: {} for n in self.tiny_hashes}
        for i in range(len(names)):
            n = int(words.first[i + 1] - words.first[i])
            if n in self.tiny_at:
                self.tiny_at[n].setdefault(int(self.tiny_hashes[n][words.first[i]]), []).append(i)
        self.whole = [i for i in range(len(names)) for _ in range(0, int(words.first[i + 1] - words.first[i]), ITEM_WORDS)]
        self.lengths = np.array([len(own) for own in self.words], np.int64)
        self.weights = self.basis = None

    def _known(self, batch):
        words = words_of(batch.column("text"), ALPHANUMERIC, FOLD_CASE)
        slot = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return words, np.where(self.vocabulary[slot] == words.hashes, slot, -1)

    def count(self, batches):
        for batch in pieces(batches):
            words, ids = self._known(batch)
            text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            pairs = np.unique(text[ids >= 0] * len(self.vocabulary) + ids[ids >= 0])
            seen = np.bincount(pairs % len(self.vocabulary), minlength=len(self.vocabulary))
            ids = np.flatnonzero(seen)
            yield pa.record_batch({"word": ids.astype(np.int32), "texts": seen[ids].astype(np.int64)})

    def find(self, batches):
        loadings = np.concatenate([self.basis * self.weights[:, None], np.zeros((1, self.basis.shape[1]))]).astype(np.float32)
        mass = np.append(self.weights**2, 0).astype(np.float32)
        rows = np.stack([loadings[p].sum(axis=0) for p in self.passages])
        # Scaled so that a passage scores 1 against itself, however much of it the latent space keeps.
        rows *= np.sqrt([[mass[p].sum()] for p in self.passages]) / np.maximum((rows**2).sum(axis=1, keepdims=True), 1e-9)
        member = np.zeros((len(self.words), len(self.vocabulary) + 1), bool)
        for i, own in enumerate(self.words):
            member[i, own] = True
        for batch in pieces(batches):
            words, ids = self._known(batch)
            at, row, cosine = self._candidates(words, ids, loadings, mass, rows, member)
            found = self._checked(words, ids, at, row, cosine, member)
            doc_ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            columns = [pa.array([f[i] for f in found], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()))]
            yield pa.record_batch([doc_ids, *columns], ["doc_id", "item_id", "start_word", "cosine", "similarity", "answer"])

    def _candidates(self, words, ids, loadings, mass, rows, member):
        """(first word, item passage, cosine) of document passages near an item passage."""
        lengths = np.diff(words.first)
        steps = -(-lengths // STEP)
        begun = np.concatenate([[0], np.cumsum(steps)])
        # A passage is two neighbouring steps of one text.
        text = np.repeat(np.arange(len(lengths)), steps)
        starts = words.first[:-1][text] + (np.arange(begun[-1]) - begun[:-1][text]) * STEP
        out = []
        lasts = words.first[1:][text]
        for low in range(0, len(starts), 1 << 12):
            high = min(len(starts), low + (1 << 12))
            more = min(len(starts), high + 1)
            place = starts[low:more, None] + np.arange(STEP)
            # Unknown words and places beyond the text take the last, zero row.
            word = np.where(place < lasts[low:more, None], ids[np.minimum(place, len(ids) - 1)], -1)
            sums, squares = loadings[word[:, 0]], mass[word].sum(axis=1)
            for i in range(1, STEP):
                sums += loadings[word[:, i]]
            here = high - low
            if len(self.brief):
                out.append(self._near(ids, starts[low:high], STEP, words, sums[:here], squares[:here], rows, self.brief, member))
            same = np.flatnonzero(text[low : min(high, len(text) - 1)] == text[low + 1 : high + 1][: min(high, len(text) - 1) - low])
            vectors, lengths2 = sums[:here].copy(), squares[:here].copy()
            vectors[same] += sums[same + 1]
            lengths2[same] += squares[same + 1]
            out.append(self._near(ids, starts[low:high], PASSAGE, words, vectors, lengths2, rows, np.arange(len(rows)), member))
        for n, wanted in self.tiny_at.items():
            at = np.flatnonzero(np.isin(windows(words.hashes, n), np.array(list(wanted), np.uint64)))
            at = at[inside_texts(words.first, len(ids), n)[at]]
            for a, h in zip(at.tolist(), windows(words.hashes, n)[at].tolist(), strict=True):
                for i in wanted[h]:
                    j = np.flatnonzero(self.owner == self.whole.index(i))[:1]
                    out.append((np.full(len(j), a), j, np.ones(len(j))))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else (np.zeros(0, np.int64),) * 3

    def _near(self, ids, starts, size, words, vectors, squares, rows, chosen, member):
        """Pairs of passage and item passage above COSINE that share SHARED of the smaller one's words."""
        out = []
        weights = np.append(self.weights, 0).astype(np.float32)
        total = np.array([self.weights[own].sum() for own in self.words])
        lasts = words.first[np.searchsorted(words.first, starts, "right")]
        busy = np.flatnonzero(squares > 0)
        for a in range(0, len(busy), 4096):
            part = busy[a : a + 4096]
            cosine = (vectors[part] / np.sqrt(squares[part])[:, None]) @ rows[chosen].T
            i, j = np.nonzero(cosine >= COSINE)
            at, value, j = starts[part[i]], cosine[i, j], chosen[j]
            place = at[:, None] + np.arange(size)
            inside = place < lasts[part[i]][:, None]
            word = np.where(inside, ids[np.minimum(place, len(ids) - 1)], -1)
            item = self.owner[j]
            shared = member[item[:, None], word]
            keep = shared.sum(axis=1) >= SHARED * np.minimum(np.minimum(self.lengths[item], size), inside.sum(axis=1))
            # A third of the item's weight, as far as a passage can hold it, must be there too.
            keep &= (shared * weights[word]).sum(axis=1) >= total[item] * np.minimum(1, size / self.lengths[item]) / 3
            out.append((at[keep], j[keep], value[keep]))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3

    def _checked(self, words, ids, at, row, cosine, member):
        """Rows of candidates that are copies or paraphrases; candidates of one item side by side are read once."""
        item = self.owner[row]
        text = np.searchsorted(words.first, at, "right") - 1
        order = np.lexsort((at, item))
        best: dict[tuple, tuple] = {}
        done = (-1, -1, -1)
        for k in order.tolist():
            t, i, place = int(text[k]), int(item[k]), int(at[k])
            own = self.words[i]
            reach = len(own) + PASSAGE
            low, high = max(int(words.first[t]), place - reach), min(int(words.first[t + 1]), place + PASSAGE + reach)
            if done[:2] == (t, i) and place + PASSAGE <= done[2]:
                continue
            near = ids[low:high]
            like = common_length(own, near[member[i, near]]) / len(own)
            done = (t, i, place + reach // 2)
            if like < (1.0 if len(own) < SHORT else ALIKE):
                continue
            # The words must stand close together, at most half as many again as the item has.
            span = -(-3 * len(own) // 2)
            tight = [(common_length(own, near[x : x + span]), x) for x in range(0, max(1, len(near) - span + len(own) // 4), max(1, len(own) // 4))]
            length, x = max(tight, key=lambda y: (y[0], -y[1]))
            like, near = length / len(own), near[x : x + span]
            if like < (1.0 if len(own) < SHORT else ALIKE):
                continue
            answer = own[-max(1, len(own) // 3) :]
            answered = common_length(answer, near) / len(answer)
            if answered < ANSWER:
                continue
            if len(own) < SHORT and not _occurs(own, near):
                continue
            value = (like, answered, float(cosine[k]))
            if (t, i) not in best or value > best[t, i][0]:
                best[t, i] = (value, place - int(words.first[t]))
        return [(t, self.names[i], place, c, like, answered) for (t, i), ((like, answered, c), place) in best.items()]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rest = full
    for word in b.tolist():
        hit = rest & where.get(word, 0)
        if hit:
            rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def _occurs(a: np.ndarray, b: np.ndarray) -> bool:
    return any(np.array_equal(b[i : i + len(a)], a) for i in np.flatnonzero(b[: len(b) - len(a) + 1] == a[0]))
