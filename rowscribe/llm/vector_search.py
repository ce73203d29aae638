"""Nearest vectors by inner product over balanced posting lists.

Equal vectors are indexed once. Centroids are learned from at most ``SAMPLE``
vectors with a penalty on crowded ones, twice as many as the root of the number of
vectors (``MOST_LISTS`` at most); every vector goes to the list of its
nearest centroid and to those at most ``SPREAD`` times as far, ``COPIES`` in all.
Centroids are searched through a neighbour graph held in memory, for vectors and for queries.
A query reads every list whose centroid is
within ``reach`` times its ``BASE``-th nearest one (the nearest may have been drawn
by the query itself, if it was in the sample). That ratio is calibrated on the sample, whose
neighbours are no nearer than those of all vectors, so that ``TARGET`` of them lie in
lists that are read; no other bound is set on the lists of a query. The ``BASE`` nearest
lists are read first; the others then send only what reaches the last score found there.
Recall is that of the calibration (at least 0.95 of the true neighbours in tests). Lists
are split into parts of about ``PART`` vectors, so no task holds a whole crowded
list. The inner product becomes a distance by one more component that gives all
vectors one length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscribe.session import cut

SAMPLE = 20_000
MOST_LISTS = 4096
PART = 2_048
COPIES = 4
SPREAD = 1.05
TARGET = 0.97
TRIALS = 512
BASE = 6
DEGREE = 16
SLACK = 1.25
#: Queries that meet one part of a list in one task; lists are repeated for more.
ASKED = 65_536


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every query.

    Both tables have vec_id and embedding; a query never finds its own vec_id.
    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than most have, nor rows without vec_id.
    Rows that repeat vec_id and embedding count once. Ties go to the smaller
    vec_id. Other columns are not read.
    """
    rows, asking = _valid(vectors), _valid(queries)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = common.n if common else 0
    rows, asking = (x.filter(F.size("embedding") == width) for x in (rows, asking))
    # Of equal vectors only the k + 1 smallest ids can ever be among k results.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    copies = rows.distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    kept = cut(copies.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "embedding"), "vectors")
    total = kept.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    asked = cut(asking.distinct().join(kept.select("rep", "embedding"), "embedding", "left").select("vec_id", F.coalesce("rep", F.lit(None).cast("long")).alias("rep"), "embedding"), "queries")
    if not total.n:
        return asked.selectExpr("vec_id query_id", "1 rank", "vec_id", "cast(0 as double) score").limit(0)
    index = Index.fit(kept, total.n, math.sqrt(total.square), k)
    # Equal queries ask once; one that is no candidate itself is named by its smallest vec_id.
    distinct = cut(asked.groupBy("embedding").agg(F.min("vec_id").alias("query")), "asked")
    slots = math.ceil(max(distinct.count(), 1) / ASKED)
    lists = kept.select("rep", "embedding").mapInArrow(lambda b: index.place(b), "rep long, embedding array<double>, list int")
    postings = cut(lists, "postings")
    sizes = F.broadcast(postings.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))  # a row for each list, MOST_LISTS at most
    postings = postings.join(sizes, "list").select("list", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "rep", "embedding")

    def scored(asking: DataFrame, nearest: bool) -> DataFrame:
        """query, rep and score of what the lists of a query hold: its nearest ones, or the others."""
        probes = asking.select("query", "embedding", "bound").mapInArrow(lambda b: index.probe(b, nearest), "query long, embedding array<double>, bound double, list int").join(sizes, "list")
        probes = probes.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query"), F.lit(slots)).cast("int").alias("slot"), "query", "embedding", "bound")
        group = ["list", "part", "slot"]
        return postings.groupBy(group).cogroup(probes.groupBy(group)).applyInArrow(lambda p, q: _best(p, q, k + 1), "query long, rep long, score double")

    # What the nearest lists give bounds what the others may send. A vector found in several lists counts once.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    once = lambda rows: rows.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    first = cut(once(scored(distinct.withColumn("bound", F.lit(-math.inf)), nearest=True)), "nearest")
    bounds = first.filter(F.col("place") == k + 1).select("query", "score")
    more = distinct.join(bounds, "query", "left").select("query", "embedding", F.coalesce("score", F.lit(-math.inf)).alias("bound"))
    top = once(first.drop("place").unionByName(scored(more, nearest=False)))
    found = top.join(kept.select("rep", "ids"), "rep").groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("worse"), "ids")).alias("found"))
    flat = F.slice(F.array_sort(F.flatten(F.transform("found", lambda f: F.transform(f.ids, lambda i: F.struct(f.worse.alias("worse"), i.alias("vec_id")))))), 1, k + 1)
    named = asked.select("vec_id", "embedding").join(distinct, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    mine = named.join(found.select("query", flat.alias("found")), "query")
    rows = mine.select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)).alias("pos", "one"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.worse")).alias("score"))


def _valid(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Index:
    def __init__(self, centroids: np.ndarray, length: float, reach: float):
        self.centroids, self.length, self.reach = centroids, length, reach
        gap = _squares(centroids, centroids)
        self.between = np.sqrt(np.maximum(gap, 0))
        degree = min(DEGREE, len(centroids))
        self.graph = np.argpartition(gap, degree - 1, axis=1)[:, :degree] if degree else np.zeros((0, 0), int)
        # The same links in both directions, so that no centroid is out of reach of a query.
        away = np.stack([np.repeat(np.arange(len(centroids)), degree), self.graph.ravel()], axis=1).astype(np.int64)
        both = np.unique(np.concatenate([away, away[:, ::-1]]), axis=0)
        self.first, self.links = np.searchsorted(both[:, 0], np.arange(len(centroids) + 1)), both[:, 1]
        # Entries spread over the centroids, each the farthest from those before.
        entries, far = [0], gap[0].copy()
        while len(entries) < min(DEGREE, len(centroids)):
            entries.append(int(far.argmax()))
            far = np.minimum(far, gap[entries[-1]])
        self.entries = np.array(entries)

    @classmethod
    def fit(cls, rows: DataFrame, count: int, length: float, k: int) -> Index:
        """Balanced centroids from at most about SAMPLE rows, chosen by a hash of their id."""
        share = min(1.0, SAMPLE / count)
        sample = rows.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("rep").select("embedding").toArrow()
        points = _matrix(sample["embedding"].combine_chunks()) if sample.num_rows else np.zeros((0, 1))
        if not len(points):
            points = _matrix(rows.limit(1).select("embedding").toArrow()["embedding"].combine_chunks())
        return cls.learned(points, count, length, k)

    @classmethod
    def learned(cls, sample: np.ndarray, count: int, length: float, k: int) -> Index:
        points = cls._lift(sample, length)
        wanted = int(min(MOST_LISTS, max(1, round(2 * math.sqrt(count))), max(1, len(points) // 4)))
        random = np.random.default_rng(11)
        # Queries that the ratio is calibrated by do not draw centroids to themselves.
        order = random.permutation(len(points))
        trials, learn = order[: min(TRIALS, len(points) // 8)], order[min(TRIALS, len(points) // 8) :]
        every, points = points, points[learn]
        centroids = points[random.choice(len(points), wanted, replace=False)]
        penalty = np.zeros(wanted)
        for _ in range(12):
            gap = _squares(points, centroids)
            owner = (gap + penalty).argmin(axis=1)
            sizes = np.bincount(owner, minlength=wanted)
            penalty += 0.05 * gap.min(axis=1).mean() * (sizes * wanted / len(points) - 1.0)
            total = np.zeros_like(centroids)
            np.add.at(total, owner, points)
            filled = sizes > 0
            centroids[filled] = total[filled] / sizes[filled, None]
        return cls(centroids, length, cls._reach(sample, every, trials, centroids, length, k))

    @classmethod
    def _reach(cls, sample: np.ndarray, points: np.ndarray, at: np.ndarray, centroids: np.ndarray, length: float, k: int) -> float:
        """The ratio within which ``TARGET`` of the ``k`` nearest of the queries ``at`` have a list."""
        if not len(at) or len(points) <= k + 1:
            return math.inf
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        gaps = np.sqrt(_squares(Index._asked(sample[at], length), centroids))
        index = cls(centroids, length, math.inf)
        ratios = np.empty(near.shape)
        for i, own in enumerate(near):
            ids, take = index.homes(points[own])
            ratios[i] = np.where(take, gaps[i][ids], np.inf).min(axis=1)
        ratios /= Index._base(gaps, length)
        return max(1.0, float(np.quantile(ratios, TARGET, method="higher")))

    @staticmethod
    def _base(gaps: np.ndarray, length: float) -> np.ndarray:
        place = min(BASE, gaps.shape[1]) - 1
        return np.maximum(np.partition(gaps, place, axis=1)[:, place : place + 1], 1e-9 * length)

    @staticmethod
    def _asked(vectors: np.ndarray, length: float) -> np.ndarray:
        # A query's own length does not matter for the order of inner products.
        norms = np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)
        return np.concatenate([vectors / norms * length, np.zeros((len(vectors), 1))], axis=1)

    @staticmethod
    def _lift(points: np.ndarray, length: float) -> np.ndarray:
        rest = np.sqrt(np.maximum(length**2 - (points**2).sum(axis=1), 0))
        return np.concatenate([points, rest[:, None]], axis=1)

    def near(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found by a best-first walk of the graph, nearest first, and their distances."""
        n, lists = len(points), len(self.centroids)
        beam = min(beam, lists)
        seen = np.zeros((n, lists), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (n, 1))
        gaps = _squares(points, self.centroids[self.entries])
        done = np.zeros(ids.shape, bool)
        rows = np.arange(n)
        while True:
            order = np.argsort(gaps, axis=1, kind="stable")[:, :beam]
            ids, gaps, done = (np.take_along_axis(x, order, axis=1) for x in (ids, gaps, done))
            waiting = ~done & np.isfinite(gaps)
            active = rows[waiting.any(axis=1)]
            if not len(active):
                return ids, np.sqrt(np.maximum(gaps, 0))
            pick = waiting[active].argmax(axis=1)
            done[active, pick] = True
            more = self.graph[ids[active, pick]]
            new = ~seen[active[:, None], more]
            seen[active[:, None], more] = True
            gap = ((points[active][:, None, :] - self.centroids[more]) ** 2).sum(axis=2)
            extra_ids, extra_gaps = np.zeros((n, more.shape[1]), ids.dtype), np.full((n, more.shape[1]), np.inf)
            extra_ids[active], extra_gaps[active] = more, np.where(new, gap, np.inf)
            ids, gaps = np.concatenate([ids, extra_ids], axis=1), np.concatenate([gaps, extra_gaps], axis=1)
            done = np.concatenate([done, np.zeros(extra_ids.shape, bool)], axis=1)

    def homes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists near each point and which of them hold it: the nearest, and near a boundary up to ``COPIES``."""
        ids, gaps = self.near(points, 2 * COPIES)
        return ids[:, :COPIES], gaps[:, :COPIES] <= SPREAD * gaps[:, :1]

    def place(self, batches):
        """Rows for the lists of each vector."""
        for batch in batches:
            points = self._lift(_matrix(batch.column("embedding")), self.length)
            for at in range(0, len(points), 1024):
                ids, take = self.homes(points[at : at + 1024])
                row, place = np.nonzero(take)
                part = batch.slice(at, len(ids))
                yield pa.record_batch({"rep": part.column("rep").take(pa.array(row)), "embedding": part.column("embedding").take(pa.array(row)), "list": ids[row, place].astype(np.int32)})

    def within(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and list of the centroids within ``reach`` of each point, and which are its ``BASE`` nearest.

        The walk finds the nearest ones; from there the graph is followed through all
        centroids within ``SLACK`` times the distance that is asked for.
        """
        ids, gaps = self.near(points, 4 * BASE)
        base = np.maximum(gaps[:, min(BASE, ids.shape[1]) - 1], 1e-9 * self.length)
        far = np.full((len(points), len(self.centroids)), np.inf)
        np.put_along_axis(far, ids, gaps, axis=1)
        limit = self.reach * base + 1e-9 * self.length
        row, node = np.nonzero(far <= SLACK * limit[:, None])
        while len(row):
            fresh = np.zeros(far.shape, bool)
            count = self.first[node + 1] - self.first[node]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            fresh[np.repeat(row, count), self.links[np.repeat(self.first[node], count) + step]] = True
            row, node = np.nonzero(fresh & np.isinf(far))
            for at in range(0, len(row), 65_536):
                r, c = row[at : at + 65_536], node[at : at + 65_536]
                far[r, c] = np.sqrt(((points[r] - self.centroids[c]) ** 2).sum(axis=1))
            go = far[row, node] <= SLACK * limit[row]
            row, node = row[go], node[go]
        # The way through the graph may have met still nearer ones.
        base = np.minimum(base, np.maximum(np.partition(far, min(BASE, far.shape[1]) - 1, axis=1)[:, min(BASE, far.shape[1]) - 1], 1e-9 * self.length))
        row, node = np.nonzero(far <= (self.reach * base + 1e-9 * self.length)[:, None])
        return row, node, far[row, node] <= base[row]

    def probe(self, batches, nearest: bool | None = None):
        """Rows for the lists each query reads: all, only the ``BASE`` nearest, or only the others."""
        for batch in batches:
            points = self._asked(_matrix(batch.column("embedding")), self.length)
            for at in range(0, len(points), 256):
                row, place, close = self.within(points[at : at + 256])
                if nearest is not None:
                    row, place = row[close == nearest], place[close == nearest]
                part = batch.slice(at, 256).take(pa.array(row))
                yield pa.record_batch({c: part.column(c) for c in part.schema.names} | {"list": place.astype(np.int32)})


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _best(postings: pa.Table, probes: pa.Table, k: int) -> pa.Table:
    """The k best of one part of a list for each of its queries, as far as they reach its bound; a block of queries at a time."""
    out = []
    if postings.num_rows and probes.num_rows:
        vectors, reps = _matrix(postings["embedding"].combine_chunks()), postings["rep"].to_numpy()
        by_id = np.argsort(reps, kind="stable")
        vectors, reps = vectors[by_id], reps[by_id]
        asked, names, bounds = _matrix(probes["embedding"].combine_chunks()), probes["query"].to_numpy(), probes["bound"].to_numpy()
        # The last bits of a sum depend on the shape of the product.
        bounds = bounds - 1e-9 * np.where(np.isfinite(bounds), np.abs(bounds), 0.0)
        for at in range(0, len(asked), 512):
            scores = asked[at : at + 512] @ vectors.T
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(scores, order, axis=1)
            row, place = np.nonzero(best >= bounds[at : at + 512, None])
            out.append((names[at + row], reps[order[row, place]], best[row, place]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(["query", "rep", "score"], columns, strict=True)))
