"""Merkle manifest of a dataset, kept as a postorder append log.

Every source is a tree of its rows' digests: each run of ``RUN`` consecutive nodes
of a level has one parent, until one node is left. The sources' roots, ordered by
source, are the leaves of one more tree. Rows are numbered inside their source by
a range partitioning, then aligned builders each take ``RUN**HEIGHT`` consecutive
leaves and append nodes in the order in which they are complete (postorder). A builder's
root is a leaf of the next round's builders, so a tree of any size takes a few
rounds and no builder holds more leaves.

A node's place in the log follows from subtree sizes alone: the node over leaves
up to (not with) number ``e`` comes after all nodes closed by the first ``e - 1``
leaves, of which there are (e - 1) // RUN**k on level k, and after the lower
nodes that end with it. Siblings are read at those places to form proofs.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscribe.session import cut

RUN = 3
#: Levels that one builder adds; it takes RUN**HEIGHT leaves.
HEIGHT = 8

LOG = "tree string, leaves long, n long, block long, nodes binary"
PATH = "tree string, block long, path array<binary>, subroot string, root string"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """SHA-256 over the fields one after the other, as hex text."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def prove(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``rows`` has doc_id, source, leaf (hex digest) and shown, the digest that is
    presented with the proof (null: the leaf itself). Leaves of a source ascend by
    doc_id, null first, then by digest; sources ascend bytewise, null first. Repeated
    rows are leaves of their own, one after the other. A tree of one leaf is that
    leaf, so its proof is empty. Other columns are dropped. An empty table gives an
    empty table.
    """
    source, leaf = F.col("source").cast("string"), F.unhex("leaf")
    shown = F.coalesce(F.unhex("shown"), leaf)
    leaves = numbered(rows.select(field(F.col("source")).alias("tree"), source.alias("first"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), shown.alias("shown")), ["first", "doc_id", "digest"])
    logs = build(leaves, height)
    # The trees' roots are the leaves of one tree more.
    tops = roots(logs, height).join(leaves.filter("index = 0").select("tree", "first"), "tree")
    upper = numbered(tops.select(F.lit("").alias("tree"), "first", F.col("tree").alias("below"), "digest"), ["first"])
    upper_logs = build(upper, height)
    paths = roots(upper_logs, height).select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<binary>").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
    paths = _descend(upper_logs[0], _to_blocks(upper_logs, paths, height), height)
    named = upper.select("index", F.col("below").alias("tree"), F.lower(F.hex("digest")).alias("top")).join(paths.drop("tree"), F.col("index") == F.col("block"))
    paths = named.select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("top").alias("subroot"), "root")
    marked = logs[0].join(_to_blocks(logs, paths, height), ["tree", "block"])
    return _in_blocks(leaves, height).groupBy("tree", "block").cogroup(marked.groupBy("tree", "block")).applyInArrow(lambda t, mark: _proofs(t, mark, height), PROVEN)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with index (from 0, by ``order`` inside the tree) and n, the rows of the tree.

    Trees must be consecutive in ``order``. Ties are cut by the place in the written
    copy, so that a row repeated many times is spread over partitions.
    """
    spot = F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("spot")
    placed = cut(rows, "leaves").select("*", spot)
    spread = placed.repartitionByRange(*order, "spot").sortWithinPartitions(*order, "spot").drop("spot")
    # The id is the partition and the place in it; written once, so that every later read sees the same.
    chunks = cut(spread.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("chunk", F.shiftright("at", 33))
    ends = chunks.groupBy("tree", "chunk").agg(F.min("at").alias("begin"), F.count("*").alias("count"))
    before = F.coalesce(F.sum("count").over(W.partitionBy("tree").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("tree", "chunk", "begin", before.alias("before"), F.sum("count").over(W.partitionBy("tree")).alias("n"))
    index = F.col("at") - F.col("begin") + F.col("before")
    return cut(chunks.join(ends, ["tree", "chunk"]).select(*rows.columns, index.alias("index"), "n"), "numbered")


def _in_blocks(leaves: DataFrame, height: int) -> DataFrame:
    return leaves.withColumn("block", F.expr(f"index div {RUN**height}"))


def build(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The append logs of all rounds: tree, leaves, n (leaves of the round), block, nodes (digests in postorder)."""
    logs, span = [], RUN**height
    leaves = leaves.select("tree", F.col("n").alias("leaves"), "n", "index", "digest")
    while True:
        log = cut(_in_blocks(leaves, height).groupBy("tree", "block").applyInArrow(lambda key, t: _append(key, t, height), LOG), "log")
        logs.append(log)
        more = log.filter(f"n > {span}").select("tree", "leaves", F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("block").alias("index"), F.expr("substring(nodes, -32, 32)").alias("digest"))
        if more.isEmpty():
            return logs
        leaves = more


def roots(logs: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree and digest of every tree's last node."""
    found = [log.filter(f"n <= {RUN**height}").select("tree", F.expr("substring(nodes, -32, 32)").alias("digest")) for log in logs]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def log_nodes(logs: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree, position (in the tree's log), level, index (on the level) and digest of every node.

    A builder's root is a leaf of the next round's log; it is given once.
    """
    out = None
    for turn, log in enumerate(logs):
        found = log.mapInArrow(lambda batches, turn=turn: _placed(batches, turn, height), "tree string, position long, level int, index long, digest string")
        out = found if out is None else out.unionByName(found)
    return out


def levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // RUN), out + 1
    return out


def positions(n: int, top: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places in the log of the nodes of one level, over ``n`` leaves and ``top`` levels."""
    closed = np.minimum((index + 1) * RUN**level, n) - 1
    return sum(closed // RUN**k for k in range(top + 1)) + level


def append(leaves: list[bytes], top: int) -> list[bytes]:
    """All nodes over the leaves, as hex text, in the order in which they are complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(top + 1)]

    def close(level: int) -> None:
        node = sha256(b"".join(open_[level])).hexdigest().encode()
        open_[level] = []
        log.append(node)
        open_[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_[0].append(leaf)
        for level in range(top):
            if len(open_[level]) < RUN:
                break
            close(level)
    for level in range(top):
        if open_[level]:
            close(level)
    return log


def _top(n: int, height: int) -> int:
    return levels(n) if n <= RUN**height else height


def _append(key: tuple, table: pa.Table, height: int) -> pa.Table:
    table = table.combine_chunks().sort_by("index")
    n = table["n"][0].as_py()
    log = append([x.as_py().hex().encode() for x in table["digest"]], _top(n, height))
    return pa.table({"tree": [key[0].as_py()], "leaves": table["leaves"][:1].combine_chunks(), "n": pa.array([n], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "nodes": pa.array([bytes.fromhex(b"".join(log).decode())], pa.binary())})


def _siblings(nodes: bytes, n: int, block: int, height: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level of a builder's log, what stands before and after each of its leaves' ancestors in their run."""
    top, text = _top(n, height), nodes.hex().encode()
    count = min(RUN**height, n - block * RUN**height)
    leaf = np.arange(count)
    found = []
    for level in range(top):
        index = leaf // RUN**level
        width = -(-count // RUN**level)
        place = positions(count, top, level, np.arange(width)) * 64
        digests = [text[p : p + 64] for p in place.tolist()]
        begin = (index - index % RUN).tolist()
        found.append(([b"".join(digests[b:i]) for b, i in zip(begin, index.tolist(), strict=True)], [b"".join(digests[i + 1 : b + RUN]) for b, i in zip(begin, index.tolist(), strict=True)]))
    return found


def _to_blocks(logs: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The paths of the first round's builders, from those of the trees' last nodes."""
    below = None
    for turn, log in reversed(list(enumerate(logs))):
        # A tree enters at the round that ends it.
        ends = log.filter(f"n <= {RUN**height}").select("tree")
        here = tops.join(ends, "tree", "left_semi")
        here = here if below is None else here.unionByName(below)
        below = _descend(log, here, height) if turn else here
    return below


def _descend(log: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """The paths of a round's leaves from those of its builders (tree, block, path, subroot, root)."""

    def extend(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                beside, first = _siblings(r["nodes"], r["n"], r["block"], height), r["block"] * RUN**height
                for i in range(min(RUN**height, r["n"] - first)):
                    own = [side[i] for level in beside for side in level]
                    rows.append({"tree": r["tree"], "block": first + i, "path": own + r["path"], "subroot": r["subroot"], "root": r["root"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.binary())), ("subroot", pa.string()), ("root", pa.string())]))

    return cut(log.join(paths, ["tree", "block"]).mapInArrow(extend, PATH), "paths")


def fold(shown: bytes, path: list[bytes]) -> bytes:
    """The root that a digest and its siblings (before, after, level by level) give."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        shown = sha256(before + shown + after).hexdigest().encode()
    return shown


def _proofs(table: pa.Table, marked: pa.Table, height: int) -> pa.Table:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if not table.num_rows:
        return pa.schema([(n, pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for n in names]).empty_table()
    table = table.combine_chunks().sort_by("index")
    mark = marked.to_pylist()[0]
    beside = _siblings(mark["nodes"], mark["n"], mark["block"], height)
    proofs, folded, found = [], [], []
    for i, (leaf, shown) in enumerate(zip(table["digest"].to_pylist(), table["shown"].to_pylist(), strict=True)):
        path = [side[i] for level in beside for side in level] + mark["path"]
        proofs.append(sha256(b"".join(path)).hexdigest())
        folded.append(fold(shown.hex().encode(), path).decode())
        found.append(leaf.hex())
    n = table.num_rows
    columns = [table["doc_id"].combine_chunks(), found, [mark["subroot"]] * n, [mark["root"]] * n, proofs, folded, [f == mark["root"] for f in folded]]
    return pa.table(dict(zip(names, columns, strict=True)))


def _placed(batches, turn: int, height: int):
    kinds = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            top, text, count = _top(r["n"], height), r["nodes"].hex(), min(RUN**height, r["n"] - r["block"] * RUN**height)
            for level in range(1 if turn else 0, top + 1):
                index = np.arange(-(-count // RUN**level))
                own = positions(count, top, level, index)
                high, index = turn * height + level, index + r["block"] * RUN ** (height - level)
                place = positions(r["leaves"], levels(r["leaves"]), high, index)
                for p, i, q in zip(place.tolist(), index.tolist(), own.tolist(), strict=True):
                    rows.append({"tree": r["tree"], "position": p, "level": high, "index": i, "digest": text[64 * q : 64 * q + 64]})
        yield pa.RecordBatch.from_pylist(rows, kinds)
