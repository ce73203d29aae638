"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units (spaces and the word after them) that no piece crosses.
The distinct units of the corpus are exploded into substrings of bounded length
and equi-joined with the piece table, and the edges are grouped by unit. A unigram
model's path is picked by Viterbi, a fold with Spark's ``aggregate``. A BPE model's
scores are ranks, so the best sum is another segmentation than its own: its
lattice is reduced by merges in order of score, in Python on Arrow batches, because
the same merges as a fold took milliseconds for each unit.

Texts that are read together form a block, compressed as a whole and written once, where
its answers are brought to it: blocks are not shuffled. A block asks for its distinct units
and gets their ids back, so a unit that every text holds is asked for once per
block. One text, and one unit, must fit into a task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm import blocks as B
from rowscribe.llm.words import bytes_of, hash_ranges
from rowscribe.llm.words import pieces as bounded
from rowscribe.session import cut, cut_by

SPACE = "▁"
#: A piece table of more rows is joined without a broadcast hint.
BROADCAST_PIECES = 1_000_000
#: A task holds about thirty times a block, and workers that wait keep much of it.
BLOCK_BYTES = B.BLOCK_BYTES // 2
#: Of compression: blocks and units are written once and read twice.
LEVEL = 6
#: Distinct units of a task whose edges are gathered by hash; those of more would be sorted.
UNITS_OF_A_TASK = 250_000
#: Blocks that lie together, and groups of them at most.
BLOCKS_OF_A_PART, MOST_PARTS = 4, 10_000
#: Units of more bytes or characters are cut into windows before they become substrings.
LONG, WINDOW = 1_024, 256
#: A span is start x WIDTH + length.
WIDTH = 64


class Model:
    """The piece table of a model file, read on the driver: a fixed vocabulary."""

    def __init__(self, path: str, kind: str = "bpe"):
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(processor.vocab_size())
        self.kind = kind
        self.bytes = {int(processor.id_to_piece(i)[3:5], 16): i for i in ids if processor.is_byte(i)}
        self.unknown = processor.unk_id()
        self.all = [processor.id_to_piece(i) for i in ids]
        self.control = {i for i in ids if processor.is_control(i) or processor.is_unknown(i)}
        rows = [(self.all[i], i, processor.get_score(i)) for i in ids if i not in self.control and not processor.is_byte(i)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in rows):
            raise ValueError("pieces with a space or a line end after other characters are not supported")
        self.rows = rows
        self.longest = max(len(p) for p, _, _ in rows)
        if self.longest >= WIDTH:
            raise ValueError(f"pieces of {WIDTH} or more characters are not supported")

    def table(self, spark: SparkSession) -> DataFrame:
        columns = list(zip(*self.rows, strict=True))
        frame = spark.createDataFrame(pa.table({"piece": columns[0], "id": pa.array(columns[1], pa.int32()), "score": pa.array(columns[2], pa.float64())}))
        return F.broadcast(frame) if len(self.rows) <= BROADCAST_PIECES else frame


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and ids (array of int) for every row.

    A null or empty text has no ids. Repeated rows are encoded alike; other
    columns are not read. An empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.select(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    count = max(1, -(-size // BLOCK_BYTES))
    packed = cut_by(rows.mapInArrow(_pack, "block long, texts binary"), "block", min(MOST_PARTS, -(-count // BLOCKS_OF_A_PART)), "blocks")
    asked = cut(packed.mapInArrow(lambda b: _ask(b, count), "bucket int, block long, longest int, n int, sizes binary, units binary"), "units")
    # Tasks of a bounded number of units, since a task holds the edges of its units.
    # What blocks ask is moved compressed, and made distinct where it meets; units are moved once each.
    longest = asked.select(F.max("longest")).first()[0] or 0
    units = asked.select("bucket", "sizes", "units").groupBy("bucket").applyInArrow(_distinct, "bucket int, unit string")
    if longest > LONG:
        units = cut(units, "distinct")
    # A bucket's units are about as many as a block's distinct ones at most, so each bucket has a task.
    units = units.repartition(count, "bucket")
    if longest > LONG:
        lattice = segment(units.filter(F.length("unit") <= LONG), model).unionByName(segment_long(units.filter(F.length("unit") > LONG), model))
    else:
        lattice = segment(units, model)
    known = lattice.mapInArrow(_answers, "bucket int, sizes binary, units binary, counts binary, ids binary")
    known = _with_edges_in_memory(docs.sparkSession, lambda: cut_by(known, "bucket", min(MOST_PARTS, count), "known"))
    told = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda a, k: _tell(a, k), "block long, bucket int, sizes binary, ids binary")
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, told: _encode(t, told, count), "doc_id long, text string, ids array<int>")


def _with_edges_in_memory(spark: SparkSession, write):
    """``write()`` with the units of a task gathered by hash; the session's setting is put back."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, UNITS_OF_A_TASK)
    try:
        return write()
    finally:
        spark.conf.set(name, before)


def segment(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (bucket, unit; distinct) with ids: the lattice and its fold."""
    word = F.translate("unit", " ", SPACE)
    rows = units.select("bucket", "unit", word.alias("word"), F.length("unit").alias("n"))
    # Edges of a unit are gathered where its substrings were made: no shuffle, and no sort of all edges.
    spelled = _spelled(rows, F.col("word"), F.lit(0), F.col("n"), F.col("n"), model)
    return _picked(spelled.groupBy("bucket", "unit", "word", "n").agg(_edges(model)), model)


def segment_long(units: DataFrame, model: Model) -> DataFrame:
    """As ``segment``, in time linear in a unit's length: substrings are made of windows, and edges carry a hash in place of the unit."""
    key = [F.xxhash64("unit").alias("key"), F.crc32("unit").alias("check")]
    rows = units.select("bucket", "unit", F.translate("unit", " ", SPACE).alias("word"), F.length("unit").alias("n"), *key)
    at = F.sequence(F.lit(0), F.col("n") - 1, F.lit(WINDOW))
    windows = F.transform(at, lambda i: F.struct(i.alias("first"), F.substring(F.col("word"), i + 1, F.lit(WINDOW + model.longest - 1)).alias("part")))
    parts = rows.select("bucket", "key", "check", F.inline(windows))
    spelled = _spelled(parts, F.col("part"), F.col("first"), F.least(F.lit(WINDOW), F.length("part")), F.length("part"), model)
    edges = spelled.groupBy("bucket", "key", "check").agg(_edges(model))
    return _picked(rows.join(edges, ["bucket", "key", "check"]).select("bucket", "unit", "word", "n", "edges"), model)


def _spelled(rows: DataFrame, part, first, starts, n, model: Model) -> DataFrame:
    """``rows`` for each substring that is a piece, with its span, id and score.

    Substrings are those of the ``n`` characters of ``part`` that begin at its first
    ``starts``; its first character is the unit's ``first``. Of those that are no piece
    only a unit's first character stays, so that a unit without pieces is not lost.
    """
    at = rows.withColumn("s", F.explode(F.sequence(F.lit(0), starts - 1)))
    each = at.withColumn("m", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("s")))))
    span = ((first + F.col("s")) * WIDTH + F.col("m")).alias("span")
    spans = each.select(*rows.columns, span, F.substring(part, F.col("s") + 1, F.col("m")).alias("piece"))
    return spans.join(model.table(rows.sparkSession), "piece", "left").filter("id IS NOT NULL OR span = 1")


def _edges(model: Model):
    edge = F.struct("span", "score", "id") if model.kind == "unigram" else F.col("span").cast("long") * F.lit(1 << 32) + F.col("id")
    return F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges")


def _picked(whole: DataFrame, model: Model) -> DataFrame:
    """Units with the ids of their path."""
    if model.kind != "unigram":
        by_byte, unknown, scores = model.bytes, model.unknown, {i: score for _, i, score in model.rows}
        return whole.select("bucket", "unit", "word", "edges").mapInArrow(lambda b: _merged(b, scores, by_byte, unknown), "bucket int, unit string, ids array<int>")
    table, ends = _viterbi()
    chosen = whole.withColumn("table", table).select("bucket", "unit", "word", F.map_from_entries(F.transform("edges", lambda e: F.struct(e.span, e.id))).alias("by_span"), ends.alias("ends"))
    by_byte = F.array(*[F.lit(model.bytes.get(i, model.unknown)) for i in range(256)])

    def ids(j):
        low, high = F.get("ends", j), F.get("ends", j + 1)
        piece = F.try_element_at("by_span", low * 64 + (high - low))
        raw = F.hex(F.encode(F.substring(F.col("word"), low + 1, high - low), "UTF-8"))
        single = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda i: F.get(by_byte, F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return F.when(piece.isNotNull(), F.array(piece)).otherwise(single if model.bytes else F.array(F.lit(model.unknown)))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ends") - 2), ids))
    return chosen.select("bucket", "unit", found.alias("ids"))


def _merged(batches, scores: dict[int, float], by_byte: dict[int, int], unknown: int):
    costs = {name: -score for name, score in scores.items()}
    for batch in batches:
        edges = batch.column("edges")
        flat = edges.flatten().to_numpy()
        spans, names = (flat >> 32).tolist(), (flat & 0xFFFFFFFF).tolist()
        counts, at, out = edges.value_lengths().to_pylist(), 0, []
        for word, count in zip(batch.column("word").to_pylist(), counts, strict=True):
            lattice = dict(zip(spans[at : at + count], names[at : at + count], strict=True))
            out.append(merge(word, lattice, costs, by_byte, unknown))
            at += count
        yield pa.record_batch([batch.column("bucket"), batch.column("unit"), pa.array(out, pa.list_(pa.int32()))], ["bucket", "unit", "ids"])


def merge(word: str, lattice: dict[int, int], costs: dict[int, float], by_byte: dict[int, int], unknown: int) -> list[int]:
    """Ids of a word: of all neighbours that join to a piece those of best score (then the leftmost) are joined, again and again.

    ``lattice``: id by start x 64 + length; ``costs``: the negative score by id.
    """
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(costs[lattice[s * 64 + 2]], s, s + 1, s + 2) for s in range(n - 1) if s * 64 + 2 in lattice]
    heapq.heapify(waiting)

    def offer(start: int) -> None:
        middle = end[start]
        if middle < n and end[middle] - start < 64:
            name = lattice.get(start * 64 + end[middle] - start)
            if name is not None:
                heapq.heappush(waiting, (costs[name], start, middle, end[middle]))

    while waiting:
        _, start, middle, stop = heapq.heappop(waiting)
        # One of the two may have been joined with another one meanwhile.
        if end[start] != middle or end[middle] != stop:
            continue
        end[start], end[middle] = stop, -1
        if stop < n:
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    ids, at = [], 0
    while at < n:
        name = lattice.get(at * 64 + end[at] - at)
        if name is not None:
            ids.append(name)
        elif by_byte:
            ids += [by_byte[b] for b in word[at : end[at]].encode()]
        else:
            ids.append(unknown)
        at = end[at]
    return ids


def _viterbi():
    """Best ways to each place, and ends of pieces, from 0, of the path of best summed score; a character that is no piece costs more than any piece."""
    worst = F.coalesce(F.array_min(F.transform("edges", lambda e: e.score)), F.lit(0.0)) - 10.0

    def step(state, end):
        into = F.filter("edges", lambda e: (e.span / 64).cast("int") + e.span % 64 == end)
        single = F.struct((F.get(state, end - 1).score + worst).alias("score"), (end - 1).alias("start"))
        ways = F.transform(into, lambda e: F.struct((F.get(state, (e.span / 64).cast("int")).score + e.score).alias("score"), (e.span / 64).cast("int").alias("start")))
        return F.concat(state, F.array(F.array_max(F.when(F.size(ways) > 0, ways).otherwise(F.array(single)))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), first, step)
    back = lambda s, _: F.when(F.get(s, F.lit(0)) == 0, s).otherwise(F.concat(F.array(F.get("table", F.get(s, F.lit(0))).start), s))
    return best, F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.col("n")), back)


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``decoded``: the text of ``ids``; unknown ids and control pieces have none, null ids no text."""
    as_hex = []
    for i, piece in enumerate(model.all):
        raw = b"" if i in model.control else piece.replace(SPACE, " ").encode()
        as_hex.append(raw.hex())
    for byte, i in model.bytes.items():
        as_hex[i] = f"{byte:02x}"
    table = F.split(F.lit(",".join(as_hex)), ",")  # one literal, not one for each piece
    text = F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")), "UTF-8")
    return rows.withColumn("decoded", F.when(F.startswith(text, F.lit(" ")), F.substring(text, F.lit(2), F.length(text))).otherwise(text))



def _pack(batches):
    """Blocks of about ``BLOCK_BYTES`` of texts, as they come; written once, so the numbers are those of one attempt."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for part in held:
                out.write_batch(part)
        return pa.record_batch({"block": pa.array([task << 32 | number], pa.int64()), "texts": pa.array([zstandard.compress(sink.getvalue(), LEVEL)], pa.binary())})

    for batch in bounded(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield block()
            number, held, size = number + 1, [], 0
    if held:
        yield block()


class _Block:
    """A block's texts and their units: of distinct ones hash, place and size, of each the number of its distinct one."""

    def __init__(self, packed: pa.Scalar):
        table = pa.ipc.open_stream(zstandard.decompress(packed.as_buffer())).read_all()
        self.doc_ids, self.texts = table["doc_id"], table["text"].combine_chunks()
        # The model puts a space before a text and takes its own sign for a space as one.
        wide = pa.large_string()
        plain = pc.replace_substring(self.texts.cast(wide), SPACE, " ")
        empty, before = pa.scalar("", wide), pa.scalar(" ", wide)
        self.data, texts = bytes_of(pc.if_else(pc.equal(plain, empty), empty, pc.binary_join_element_wise(before, plain, empty)))
        del plain
        space, line = self.data == 0x20, self.data == 0x0A
        begins = space | line
        begins[1:] &= ~(space[1:] & space[:-1])
        begins[1:] |= line[:-1]
        begins[texts[:-1][texts[1:] > texts[:-1]]] = True
        del space, line
        starts = np.flatnonzero(begins)
        del begins
        ends = np.append(starts[1:], len(self.data))[: len(starts)]
        self.first = np.searchsorted(starts, texts)
        hashes = hash_ranges(self.data, starts, [ends])[0]
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.append(np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1])
        self.units, example = hashes[new], order[new]
        self.at, self.sizes = starts[example], ends[example] - starts[example]
        del starts, ends, hashes
        self.unit_of = np.empty(len(order), np.int32)
        self.unit_of[order] = np.cumsum(new, dtype=np.int32) - 1

    def asked(self, buckets: int):
        """(bucket, numbers of its units, these units), in order of their spelling: neighbours compress well."""
        ends = np.cumsum(self.sizes)
        source = np.repeat(self.at - (ends - self.sizes), self.sizes) + np.arange(self.sizes.sum())
        offsets = np.append(0, ends).astype(np.int32)
        spelled = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[source])])
        for bucket, part in B.bucket_slices(self.units, buckets):
            order = pc.sort_indices(spelled[part])
            yield bucket, part.start + order.to_numpy(), spelled[part].take(order)


def _ask(batches, buckets: int):
    for batch in batches:
        for number, packed in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
            yield _questions(_Block(packed), number, buckets)


def _questions(block: _Block, number: int, buckets: int) -> pa.RecordBatch:
    names = {"bucket": pa.int32(), "block": pa.int64(), "longest": pa.int32(), "n": pa.int32(), "sizes": pa.binary(), "units": pa.binary()}
    rows = []
    for bucket, _, units in block.asked(buckets):
        raw, ends = bytes_of(units)
        sizes = np.diff(ends)
        rows.append((bucket, number, int(sizes.max()), len(sizes), _squeezed(sizes, np.uint32), zstandard.compress(raw.tobytes(), LEVEL)))
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())], list(names))


def _squeezed(numbers: np.ndarray, kind) -> bytes:
    """Compressed: first the lowest byte of all numbers, then the next one, as the high ones hardly differ."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), LEVEL)


def _unsqueezed(packed: pa.Scalar, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed.as_buffer()), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _asked_units(sizes, units) -> pa.Array:
    lengths = _unsqueezed(sizes, np.uint32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(units.as_py())))


def _distinct(asked: pa.Table) -> pa.Table:
    """The distinct units that blocks ask a bucket for."""
    units = pa.chunked_array([_asked_units(s, u) for s, u in zip(asked["sizes"], asked["units"], strict=True)], pa.string()).unique()
    return pa.table({"bucket": pa.array(np.full(len(units), asked["bucket"][0].as_py(), np.int32)), "unit": units})


def _answers(batches):
    """Units and ids of a bucket, compressed for each batch."""
    for batch in batches:
        rows = []
        for bucket in pc.unique(batch.column("bucket")):
            part = batch.filter(pc.equal(batch.column("bucket"), bucket)).sort_by("unit")
            units, ids = bytes_of(part.column("unit")), part.column("ids")
            rows.append((bucket.as_py(), _squeezed(np.diff(units[1]), np.uint32), zstandard.compress(units[0].tobytes(), LEVEL), _squeezed(ids.value_lengths().to_numpy(), np.uint32), _squeezed(ids.flatten().to_numpy(), np.int32)))
        kinds = {"bucket": pa.int32(), "sizes": pa.binary(), "units": pa.binary(), "counts": pa.binary(), "ids": pa.binary()}
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _tell(asked: pa.Table, known: pa.Table) -> pa.Table:
    names = pa.chunked_array([_asked_units(s, u) for s, u in zip(known["sizes"], known["units"], strict=True)], pa.string()).combine_chunks()
    ends = np.concatenate([[0], np.cumsum(_opened(known["counts"], np.uint32))]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(_opened(known["ids"], np.int32)))
    rows, each = [], [_asked_units(s, u) for s, u in zip(asked["sizes"], asked["units"], strict=True)]
    # One look-up for all blocks, as each would hash all names.
    places = pc.index_in(pa.chunked_array(each, pa.string()), value_set=names).combine_chunks()
    last = 0
    for block, bucket, units in zip(asked["block"].to_pylist(), asked["bucket"].to_pylist(), each, strict=True):
        found = ids.take(places.slice(last, len(units)))
        last += len(units)
        rows.append((block, bucket, _squeezed(found.value_lengths().to_numpy(), np.uint32), _squeezed(found.flatten().to_numpy(), np.int32)))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(["block", "bucket", "sizes", "ids"], kinds, strict=True))})


def _encode(table: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    block = _Block(table["texts"][0])
    told = told.combine_chunks().sort_by("bucket")
    # In order of buckets the answers are in the order of the questions.
    order = np.concatenate([np.zeros(0, np.int64), *(numbers for _, numbers, _ in block.asked(buckets))]).astype(np.int64)
    sizes, begun = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    sizes[order] = _opened(told["sizes"], np.uint32)
    begun[order] = np.cumsum(sizes[order]) - sizes[order]
    ids = _opened(told["ids"], np.int32)
    lengths = sizes[block.unit_of]
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    # A list's offsets are of 32 bits, so the places of its ids are too.
    offsets = pa.array(ends[block.first], pa.int32())
    source = np.repeat(begun[block.unit_of] - ends[:-1].astype(np.int32), lengths)
    source += np.arange(ends[-1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.array(ids[source], pa.int32()))
    return pa.table({"doc_id": block.doc_ids, "text": block.texts, "ids": lists})


def _opened(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unsqueezed(x, kind) for x in column)])
