"""Merkle manifest, whitening and the Jaccard join against plain Python and numpy."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowscribe.llm import jaccard_join, merkle, queries, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, index int, digest string"


def H(text):
    return sha256(text.encode()).hexdigest()


def fields(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree_of(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([H("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def path_of(rows, i):
    out = []
    for row in rows[:-1]:
        begin = i // 3 * 3
        out.append(("".join(row[begin:i]), "".join(row[i + 1 : begin + 3])))
        i //= 3
    return out


def proven(docs):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, by plain recursion."""
    leaf = lambda r, text: H(fields(r[0], r[1], r[2], r[3], text))
    trees = defaultdict(list)
    for r in docs:
        trees[r[1]].append((r[0], leaf(r, r[4]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {name: tree_of([x[1] for x in trees[name]]) for name in names}
    top = tree_of([built[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (doc_id, own, r) in enumerate(trees[name]):
            path = path_of(built[name], i) + path_of(top, k)
            shown = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                shown = leaf(r, r[4] and r[4].replace("\n", ""))
            for before, after in path:
                shown = H(before + shown + after)
            out.append((doc_id, own, built[name][-1][0], top[-1][0], H("".join(a + b for a, b in path)), shown, shown == top[-1][0]))
    return Counter(out)


def merkle_rows(docs):
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.digest(*named, F.replace("text", F.lit("\n"), F.lit(""))))
    return docs.withColumn("leaf", merkle.digest(*named, F.col("text"))).withColumn("shown", shown)


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest(many_chunks, height):
    r = random.Random(height)
    docs = [(i, r.choice(["hot", "hot", "hot", "é", "", None, f"s{i % 13}"]), r.choice(["en", None]), r.choice([i, None]), r.choice(["", None, f"a\nb{i}", "é" * 3, "x\n" * 2000])) for i in range(170)]
    docs += [docs[3]] * 12 + [(None, "hot", "en", 1, "no\nid"), (None, None, None, None, None), (7, "hot", "other", 0, "twice"), (900, "lone", "en", 3, "one\nleaf")]
    table = many_chunks.createDataFrame([(*d, "t", 1, "d") for d in docs], DOCS)
    got = Counter(tuple(x) for x in merkle.prove(merkle_rows(table), height).collect())
    assert got == proven(docs)
    assert any(not x[-1] for x in got) and any(x[-1] for x in got)


def test_manifest_of_few_rows(spark):
    one = [(1, "a", "en", 1, "text")]
    table = spark.createDataFrame([(*d, "t", 1, "d") for d in one], DOCS)
    got = merkle.prove(merkle_rows(table)).collect()
    assert Counter(map(tuple, got)) == proven(one) and got[0].root == got[0].leaf and got[0].proof_sha256 == H("")
    assert merkle.prove(merkle_rows(table.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80, 200])
def test_log_is_in_postorder(spark, n):
    leaves = [H(str(i)) for i in range(n)]
    rows = tree_of(leaves)

    def walk(level, i):
        below = [] if level == 0 else [x for j in range(3 * i, min(3 * i + 3, len(rows[level - 1]))) for x in walk(level - 1, j)]
        return [*below, (level, i, rows[level][i])]

    table = spark.createDataFrame([("t", n, i, bytes.fromhex(x)) for i, x in enumerate(leaves)], "tree string, n long, index long, digest binary")
    found = sorted((r.position, r.level, r["index"], r.digest) for r in merkle.log_nodes(merkle.build(table, 2), 2).collect())
    assert found == [(p, *node) for p, node in enumerate(walk(len(rows) - 1, 0))]


def whitened_plain(vectors):
    x = np.floor(64 * np.array([v for _, v in vectors])) + 1_000_000
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / len(x)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    keep = values > 1e-10 * values[0]
    return values[keep], (centred @ axes[:, keep]) / np.sqrt(values[keep]), np.trace(covariance)


def check_white(rows, vectors, components):
    values, want, trace = whitened_plain(vectors)
    k, n = min(components, len(values)), len(vectors)
    got = defaultdict(list)
    for r in rows:
        got[r.component].append((r.vec_id, r.whitened, r.explained, r.deviation, r.n, r.identity_error))
    assert sorted(got) == list(range(1, k + 1))
    whole = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(w, sums, strict=True)) for (i, _), w in zip(vectors, whole, strict=True)}
    for c in got:
        assert len(got[c]) == n and {x[4] for x in got[c]} == {n} and max(x[5] for x in got[c]) <= 1e-9
        assert abs(got[c][0][2] - values[c - 1] / trace) <= 1e-9
        assert all(x[3] == deviation[x[0]] for x in got[c])
        mine, other = dict(x[:2] for x in got[c]), {i: want[row, c - 1] for row, (i, _) in enumerate(vectors)}
        sign = np.sign(sum(mine[i] * other[i] for i in mine))
        assert max(abs(mine[i] - sign * other[i]) for i in mine) <= 1e-7


def test_whitening(many_chunks):
    r = np.random.default_rng(5)
    good = [(i, (r.standard_normal(40) * np.linspace(1, 3, 40)).tolist()) for i in range(300)]
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [1.0, 2.0]), (905, [float("-inf")] * 40), (906, [1e300] * 40)]
    table = many_chunks.createDataFrame([(*x, 1, 2.0) for x in good + bad], "vec_id long, embedding array<double>, n int, component double")
    check_white(whitening.whiten(table).collect(), good, 32)
    check_white(whitening.whiten(table, 5).collect(), good, 5)


def test_whitening_of_flat_tables(spark):
    kind = "vec_id long, embedding array<double>"
    r = np.random.default_rng(6)
    plane = [(i, [float(a), float(b), float(a + b), 7.0]) for i, (a, b) in enumerate(r.integers(-50, 50, (60, 2)))]
    check_white(whitening.whiten(spark.createDataFrame(plane, kind)).collect(), plane, 32)
    line = [(i, [i / 4.0]) for i in range(9)]
    check_white(whitening.whiten(spark.createDataFrame(line, kind)).collect(), line, 32)
    for same in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], []):
        assert whitening.whiten(spark.createDataFrame(same, kind)).collect() == []
    repeated = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (None, [5.0, 1.0])]
    assert whitening.whiten(spark.createDataFrame(repeated, kind)).count() == 8


def test_deviation_beyond_a_long():
    x = np.array([[1_000_064, 1_000_000], [1 << 40, 5]])
    sums = [int(s) for s in x.sum(axis=0)]
    exact = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 2, sums) == [e if e < 1 << 63 else None for e in exact]


def spectra():
    r = np.random.default_rng(8)
    turn, _ = np.linalg.qr(r.standard_normal((50, 50)))
    a = r.standard_normal((200, 50))
    yield a.T @ a
    yield turn @ np.diag([9.0] * 12 + [4.0] * 20 + [1.0] * 18) @ turn.T
    yield turn @ np.diag(np.r_[np.ones(6), 1 + 1e-6 * np.arange(44)]) @ turn.T
    yield turn @ np.diag(10.0 ** (-np.arange(50) / 6)) @ turn.T
    low = r.standard_normal((9, 50))
    yield low.T @ low


@pytest.mark.parametrize("matrix", list(spectra()))
def test_contour_misses_no_component(matrix):
    matrix = (matrix + matrix.T) / 2
    exact = np.linalg.eigvalsh(matrix)[::-1]
    for shift in (exact[0] * 0.3, exact[0] * 0.77):
        assert whitening.inertia(matrix, shift) == (exact > shift).sum()
    parts = whitening.slices(matrix, 32)
    values = np.concatenate([whitening.feast(matrix, *part)[0] for part in parts])
    assert len(values) == sum(p[2] for p in parts) >= min(32, (exact > 1e-12 * exact[0]).sum())
    assert np.abs(values - exact[: len(values)]).max() <= 1e-10 * exact[0]


def joined(docs, percent=80):
    """(doc_id, set size, component) of every row, from all pairs that share a shingle."""
    sets = []
    for _, text in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    lists, both, up = defaultdict(list), Counter(), list(range(len(docs)))
    for i, s in enumerate(sets):
        for gram in s:
            lists[gram].append(i)
    for members in lists.values():
        both.update((a, b) for k, b in enumerate(members) for a in members[:k])

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter((doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(docs))


def copies(r, words, share):
    out = list(words)
    for i in range(len(out)):
        if r.random() < share:
            out[i] = f"new{r.randrange(10**6)}"
    return out


def near_texts(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passages = [[word() for _ in range(45)] for _ in range(6)]
    docs = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(5, 260))]
        docs += [copies(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.04, 0.06])) for _ in range(r.randrange(1, 9))]
    # Texts of shared passages, and a group whose members lie about the threshold.
    docs += [sum(r.sample(passages, r.randrange(1, 6)), []) + [word()] * r.randrange(3) for _ in range(60)]
    group = [word() for _ in range(120)]
    docs += [copies(r, group, 0.02) for _ in range(90)]
    texts = [" ".join(d) for d in docs] + ["", None, " \t\n", "One two", "one TWO", "one two three", "a b c d e", "A B c d e\n", "é É é É é", "  lead " + "x " * 3000, "y " * 3001]
    return [(i + 10, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 100, 55])
def test_jaccard_components(many_chunks, monkeypatch, percent):
    docs = near_texts(percent)
    docs += [docs[0], docs[0], (docs[1][0], "another text of the same id " * 2), (None, docs[2][1]), (None, "alone " * 9 + "without id"), (None, docs[40][1] + " tail")]
    table = many_chunks.createDataFrame([(*d, 1, "n", 2) for d in docs], "doc_id long, text string, node int, tokens string, block int")
    # Small limits cut the work into many buckets, blocks and chunks.
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 7)
    got = Counter(tuple(r) for r in jaccard_join.linked_components(table, percent).collect())
    assert got == joined(docs, percent)


def test_jaccard_block_takes_bounded_memory():
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 9000, 400)) for _ in range(jaccard_join.BLOCK_BYTES // 2300)]
    kinds = {"block": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}
    block = pa.table({"block": pa.array([0] * len(texts), pa.int32()), "node": pa.array(range(len(texts)), pa.int64()), "text": texts})
    tracemalloc.start()
    found = jaccard_join._prefixes(block, pa.table({n: pa.array([], k) for n, k in kinds.items()}), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 0 and peak < 150e6


def test_jaccard_of_few_rows(spark):
    kind = "doc_id long, text string"
    for docs in ([], [(5, None)], [(3, "a b c d e f"), (2, "A b c d e f")], [(1, "")]):
        got = Counter(tuple(r) for r in jaccard_join.linked_components(spark.createDataFrame(docs, kind)).collect())
        assert got == joined(docs)


def test_new_queries_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op11_merkle"](spark, folder).collect()) == proven(rows)
    assert Counter(tuple(r) for r in queries.QUERIES["op13_jaccard_join"](spark, folder).collect()) == joined([(r[0], r[4]) for r in rows])
    vectors = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None]
    check_white(queries.QUERIES["op12_whitening"](spark, folder).collect(), vectors, 32)
