"""Operators on texts against plain Python, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import random
import re
import time
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowscribe import session
from rowscribe.llm import decontamination, language_id, license_scan, near_dedup, pieces, substring_dedup, surrogates, toxicity
from rowscribe.llm import words as W
from rowscribe.llm.license_rules import BASE, RULES
from rowscribe.llm.queries import piece_model

EXTRA = "block int, node string, row string, n int, kind string, _key string"


def table(spark, rows, schema="doc_id long, text string"):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z", "k") for r in rows], f"{schema}, {EXTRA}")


def sentence(random, n, size=400):
    return " ".join(f"w{random.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(3)
    long = sentence(r, 30_000, 5000)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, long), (6, long), (7, "one"), (7, "one"), (None, "no id here"), (8, "x" * 50_000), (9, "é" * 300 + " ü")]


def test_words_against_regex():
    r = random.Random(2)
    texts = [None, "", " ", "a", "  é\tü b  ", *("".join(r.choice("ab \né") for _ in range(r.randint(0, 60))) for _ in range(200))]
    words = W.words_of(pa.array(texts), W.NOT_SPACE)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert list(np.diff(words.first)) == [len(x) for x in want]
    flat = [x for one in want for x in one]
    assert len(set(words.hashes.tolist())) == len(set(flat))
    keep = np.random.default_rng(1).random(len(flat)) < 0.6
    each = iter(keep)
    assert W.join_words(words, keep).to_pylist() == [" ".join(x for x in one if next(each)) for one in want]


def brute_removal(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 12])
def test_substring_dedup(spark, odd_rows, window, monkeypatch):
    monkeypatch.setattr(substring_dedup.B, "BLOCK_BYTES", 60_000)
    r = random.Random(window)
    shared = [sentence(r, n) for n in (window - 1, window, window + 3, 3 * window)]
    rows = [(100 + i, " ".join(r.choice([sentence(r, r.randint(1, 2 * window), 8), r.choice(shared)]) for _ in range(4))) for i in range(60)]
    rows += [*odd_rows, (999, "a " * 50)]
    found = substring_dedup.remove_repeats(table(spark, rows), window).collect()
    assert sorted(((f.doc_id, f.kept, f.n_words, f.n_removed) for f in found), key=str) == brute_removal(rows, window)
    assert all(sum(s.end - s.start for s in f.spans) == f.n_removed for f in found)
    assert substring_dedup.remove_repeats(table(spark, []), window).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    r = random.Random(4)
    for _ in range(400):
        a = [r.randint(0, 6) for _ in range(r.randint(1, 60))]
        b = a[:]
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = [r.randint(0, 6)] * r.randint(0, 1)
        want = edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert near_dedup.alike(np.array(a, np.uint32), np.array(b, np.uint32)) == want


def test_near_dedup_classes(spark, odd_rows):
    r = random.Random(9)
    rows, planted = [], {}
    for base in range(20):
        words = sentence(r, 120, 3000).split()
        for copy in range(4):
            edited = words[:]
            for _ in range(copy * 2):
                edited[r.randrange(len(edited))] = f"new{r.random()}"
            planted[1000 + base * 10 + copy] = 1000 + base * 10
            rows.append((1000 + base * 10 + copy, " ".join(edited)))
    found = near_dedup.classes(table(spark, rows + odd_rows)).collect()
    assert len(found) == len(rows) + len(odd_rows)
    of = {f.doc_id: f.class_id for f in found}
    assert all(of[d] == c for d, c in planted.items())
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[7] == 4 and of[5] == of[6] == 5 and of[None] is None
    assert near_dedup.classes(table(spark, [])).count() == 0


def test_near_dedup_moves_needed_texts_only(spark, monkeypatch):
    rows = [(i - 500, f"text {i}") for i in range(2000)] + [(None, "no id"), (7, "again")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    one = spark.createDataFrame([(i, i) for i in range(-500, 1500, 40)], "node long, doc_id long")
    wanted = sorted(t for d, t in rows if d is not None and (d + 500) % 40 == 0)
    for bits, most in ((near_dedup.BITS, len(wanted) + 5), (64, len(rows))):
        monkeypatch.setattr(near_dedup, "BITS", bits)
        held = near_dedup._needed(texts, one)
        assert len(wanted) <= held.count() <= most
        assert sorted(r.text for r in held.join(one, "doc_id").collect()) == wanted


def test_near_dedup_drops_unlike_pairs_before_their_words_move():
    r = random.Random(8)
    texts = [sentence(r, 300) for _ in range(12)]
    texts += [" ".join(w for w in t.split() if r.random() > 0.12) for t in texts] + ["a " * 2000, "a " * 1700, "", "one"]
    spelled = [W.words_of(pa.array([t]), W.ALPHANUMERIC, W.FOLD_CASE) for t in texts]
    nodes = pa.array([int(near_dedup._whole(w).view(np.int64)[0]) for w in spelled])
    rows = next(near_dedup._spell([pa.record_batch({"node": nodes, "text": texts})])).to_pylist()
    words = [np.frombuffer(x["words"], np.uint32) for x in rows]
    every = [(i, j) for i in range(len(rows)) for j in range(i)]
    kinds = {"a": pa.int64(), "b": pa.int64(), "n_a": pa.int32(), "n_b": pa.int32(), "bag_a": pa.binary(), "bag_b": pa.binary()}
    values = [(i, j, rows[i]["n"], rows[j]["n"], rows[i]["bag"], rows[j]["bag"]) for i, j in every]
    batch = pa.record_batch([pa.array([v[k] for v in values], kind) for k, kind in enumerate(kinds.values())], list(kinds))
    left = {(x["a"], x["b"]) for x in next(near_dedup._likely([batch])).to_pylist()}
    alike = {(i, j) for i, j in every if near_dedup.alike(words[i], words[j])}
    assert len(alike) >= 12 and alike <= left and len(left) < len(every) / 4


def test_near_dedup_drops_unlike_pairs_of_a_bucket_where_they_are_formed(spark):
    texts = pa.array([f"head line {' '.join(f'w{i}x{j}' for j in range(20))}" for i in range(30)])
    found = next(near_dedup._sketches([pa.record_batch({"doc_id": pa.array(range(30), pa.int64()), "text": texts})]))
    spelled = next(near_dedup._spell([pa.record_batch({"node": found.column("node"), "text": texts})]))
    assert found.column("bag").to_pylist() == spelled.column("bag").to_pylist()
    nodes = spark.createDataFrame(pa.Table.from_batches([found]))
    shared = nodes.select(F.lit(1).alias("bucket"), "node", "n", F.lit(0).alias("least"))
    roots = spark.createDataFrame([], "node long, root long")
    # All of one bucket and of equal lengths: 435 pairs before, none of which can align.
    assert near_dedup._left(shared, nodes, roots).count() == 0


def test_a_cut_leaves_no_shuffle_files(spark, tmp_path):
    before = spark.conf.get(session.CLEAN_UP)
    seen = sum(1 for _ in shuffle_files())
    session.cut(spark.range(50_000).repartition(7, "id"))
    for _ in range(50):
        if sum(1 for _ in shuffle_files()) <= seen:
            break
        time.sleep(0.1)
    assert sum(1 for _ in shuffle_files()) <= seen and spark.conf.get(session.CLEAN_UP) == before


def shuffle_files():
    """Shuffle data of this session's block manager."""
    folders = SparkSession.getActiveSession().sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return (f for d in folders for f in Path(d).rglob("shuffle_*.data"))


def test_near_dedup_below_a_shared_passage(spark):
    r = random.Random(21)
    passage, rows = sentence(r, 140, 3000), []
    for i in range(40):
        own = [f"own{r.randrange(10**12)}" for _ in range(60)]
        copy = [f"new{r.randrange(10**12)}" if j % 2 else w for j, w in enumerate(own)]
        rows += [(1000 + i, f"{passage} {' '.join(own)}"), (2000 + i, f"{passage} {' '.join(copy)}")]
    of = {f.doc_id: f.class_id for f in near_dedup.classes(table(spark, rows)).collect()}
    assert all(of[1000 + i] == of[2000 + i] == 1000 + i for i in range(40))


def test_near_dedup_at_the_threshold(spark):
    r = random.Random(22)
    rows, wanted = [], []
    for i in range(150):
        words = sentence(r, r.randint(10, 120), 3000).split()
        edited, limit = words[:], len(words) // 5
        for j in range(limit):
            # Every fifth word, so that no five-word run survives; or places at random.
            at = 5 * j + 2 if i % 2 else r.randrange(len(edited))
            if i % 3:
                edited[at] = f"new{r.randrange(10**12)}"
            elif j % 2:
                edited.insert(at, f"new{r.randrange(10**12)}")
            else:
                edited.pop(at)
        rows += [(1000 + i, " ".join(words)), (2000 + i, " ".join(edited))]
        distance = edit_distance(words, edited)
        if 5 * distance <= max(len(words), len(edited)):
            wanted.append((i, 1 - distance / max(len(words), len(edited))))
    of = {f.doc_id: f.class_id for f in near_dedup.classes(table(spark, rows)).collect()}
    assert len(wanted) > 100 and sum(s <= 0.85 for _, s in wanted) > 100
    assert sum(of[2000 + i] == 1000 + i for i, _ in wanted) >= 0.99 * len(wanted)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7)], "a long, b long")
    assert {(r.node, r.root) for r in near_dedup.components(links).collect()} == {(i, 0) for i in [*range(41), 100]}


def test_decontamination(spark, odd_rows):
    r = random.Random(5)
    items = [(i, sentence(r, 40, 3000)) for i in range(30)] + [(50, None), (51, ""), (52, "tiny item of five words"), (3, "another text under the same id " + sentence(r, 30, 3000))]
    leak = items[7][1].split()
    loose = leak[:]
    for i in range(2, 40, 5):
        loose[i] = "changed"
    loose.insert(11, "inserted")
    rows = [(200, f"{sentence(r, 70)} {items[4][1]} {sentence(r, 50)}"), (201, f"{sentence(r, 33)} {' '.join(loose)}"), (202, sentence(r, 300)), (203, " ".join(sorted(leak))), (204, "so a tiny item of five words stands here")]
    found = decontamination.contaminated(table(spark, rows + odd_rows), table(spark, items, "item_id long, text string")).collect()
    assert {(f.doc_id, f.item_id) for f in found} == {(200, 4), (201, 7), (204, 52)}
    assert decontamination.contaminated(table(spark, []), table(spark, items, "item_id long, text string")).count() == 0
    assert decontamination.contaminated(table(spark, rows), table(spark, [], "item_id long, text string")).count() == 0


def test_long_items_have_no_short_piece():
    words = [f"w{i}" for i in range(2 * decontamination.ITEM_WORDS + 1)]
    items = decontamination.Items([7, 8], pa.array([" ".join(words), " ".join(words[:20])]))
    assert items.names == [7, 7, 7, 8] and items.lengths.tolist() == [256, 256, 256, 20] and not len(items.tiny)
    assert len(set(np.concatenate(items.words[:3]).tolist())) == len(words)


def test_common_length():
    r = random.Random(6)
    for _ in range(100):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        assert decontamination.common_length(np.array(a), np.array(b)) == row[-1]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd_rows):
    rows = [(20, "Licensed under CC BY-NC 4.0. Released under the MIT License."), (21, "This work is licensed under the GNU General Public License, version 3."), (22, "Apache License, Version 2.0; apache license version 2"), (23, "the under of mit"), (24, "cc by nc sa cc by nc"), *odd_rows]
    found = {(f.doc_id, f.n_words): f for f in license_scan.scan(table(spark, rows)).collect()}
    for doc, text in rows:
        n, places, first, last, labels = brute_base(text)
        f = found[doc, n]
        assert (f.n_base, f.first_word, f.last_word, f.base_labels) == (places, first, last, labels)
        assert set(labels.split(",")) - {""} <= set(f.labels.split(","))
    assert found[21, 12].labels == "gpl-3" and 0 < found[21, 12].score < 1
    assert found[24, 7].labels == "cc-by-nc,cc-by-nc-sa"
    assert len(RULES) > 300 and license_scan.scan(table(spark, [])).count() == 0


def test_license_rules_against_all_positions():
    """The keyword gate loses nothing: rules over the whole text find what rules near keywords find."""
    texts = [f"so {name} license version 2 is released under the {name} license" for name in ("mit", "zlib", "isc", "new bsd", "artistic")]
    for text in texts:
        words = W.words_of(pa.array([text]), W.ALPHANUMERIC, W.FOLD_CASE)
        whole = license_scan.settle(license_scan._matches(words, 0, len(words.starts)))
        batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
        assert next(license_scan._scan([batch])).column("detections").to_pylist()[0] == whole


def test_toxicity(spark, odd_rows):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i + 1000, sentence(r, 40) + (" you pathetic idiot" * 2 if bad else "")))
        labels.append((i + 1000, int(bad)))
    found = {f.doc_id: f for f in toxicity.score(table(spark, rows + odd_rows), spark.createDataFrame([*labels, (5, None), (None, 1), (1000, 1)], "doc_id long, toxic int")).collect()}
    import zlib

    right = sum(found[d].predicted == t for d, t in labels if found[d].held_out)
    held = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(found[d].held_out for d in held) and right >= 0.95 * len(held)
    assert all(0 <= f.score <= 1 and f.predicted == int(f.score >= 0.3) for f in found.values())
    none = toxicity.score(table(spark, odd_rows), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(odd_rows) and all(f.score == 0 for f in none)


def test_language_id(spark, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = docs.select("text", "lang")
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) declared", "cast(null as string) host", "cast(null as string) suffix")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language_id.identify(bare, labelled).collect()
    assert sum(truth[f.doc_id] == f.language for f in found) >= 0.97 * len(truth)
    strange = spark.createDataFrame([(*row, None, "h", "x", 1) for row in odd_rows] + [(70, "zzqx " * 40, None, None, None, 1)], "doc_id long, text string, declared string, host string, suffix string, language int")
    odd = {f.doc_id: f for f in language_id.identify(strange, labelled).collect()}
    assert odd[70].language == "und" and not odd[70].accepted
    assert language_id.identify(bare.limit(0), labelled).count() == 0
    assert {f.language for f in language_id.identify(bare, labelled.limit(0)).collect()} == {"und"}
    pages = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>Der die das</p>'), (2, None, None)], "page_id long, url string, html string")
    row = language_id.page_evidence(pages).collect()
    assert (row[0].declared, row[0].host, row[0].suffix) == ("de", "a.example.de", "de") and row[1].text is None


def test_surrogates(spark, odd_rows):
    text = "Mr. John Smith met Mrs Smith at a.b@mail.de and A.B@mail.de, +1 (017) 555-7713 or +1-017-555-7713; 4111 1111 1111 1111, 4111111111111111, 1.2.3.4"
    rows = [(50, text), (51, text), (52, "write to a.b@mail.de or c.d@mail.de"), *odd_rows]
    found = surrogates.replace_entities(table(spark, rows), "k", found="found").collect()
    assert set(found[0].asDict()) == {"doc_id", "text", "found", *(c.split()[0] for c in EXTRA.split(", "))}
    new = {f.doc_id: f for f in found}
    assert new[50].text == new[51].text and new[50].found == 9
    parts = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) at (\S+)@(\S+) and (\S+)@(\S+), (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4}); (\d{4} \d{4} \d{4} \d{4}), (\d{16}), (\d+\.\d+\.\d+\.\d+)", new[50].text)
    assert parts and parts[1] in surrogates.GIVEN["m"]["latin"] and parts[2] == parts[3] != "Smith"
    assert parts[4].lower() == parts[6].lower() and parts[5].rstrip(",") == parts[7].rstrip(",")
    assert re.sub(r"\D", "", parts[8]) == re.sub(r"\D", "", parts[9]) and parts[10].replace(" ", "") == parts[11]
    digits = [int(c) for c in parts[11]]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    assert parts[4] in new[52].text and len(set(re.findall(r"\S+@\S+", new[52].text))) == 2
    unchanged = {(d, t) for d, t in odd_rows}
    assert {(f.doc_id, f.text) for f in found if f.doc_id not in (50, 51, 52)} == unchanged
    assert surrogates.replace_entities(table(spark, []), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr {chr(65 + i % 26)}{chr(97 + i // 26)}xon") for i in range(200)]
    found = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    assert len({f.text for f in found}) == 200 and not {f.text for f in found} & {t for _, t in rows}


def test_pieces_of_a_block_take_bounded_memory(monkeypatch):
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.3, 400) % 300_000) for _ in range(9000)]
    monkeypatch.setattr(pieces, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    blocks = list(pieces._pack([batch, batch]))
    assert len(blocks) > 1
    tracemalloc.start()
    asked = sum(out.nbytes for out in pieces._ask(blocks, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Neighbours in spelling compress well.
    distinct = {w for t in texts for w in t.split()}
    assert peak < 200e6 and asked < 0.4 * len(blocks) * sum(map(len, distinct))


def test_pieces(spark, odd_rows):
    import sentencepiece

    model = piece_model()
    own = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    rows = [(60, "Hello  world\nfoo\tbar é 你好 a"), (61, "x▁y"), (62, "\n\n a  "), (63, "1234567 http://www.example.com/"), (64, "ab é" + "the cat你sat" * 3_000 + " end"), *odd_rows]
    found = pieces.decode(pieces.encode(table(spark, rows), model), model).collect()
    assert len(found) == len(rows)
    for f in found:
        assert list(f.ids) == (own.encode(f.text) if f.text else [])
        assert f.decoded == (f.text or "").replace("▁", " ")
    assert pieces.encode(table(spark, []), model).count() == 0


def test_pieces_moves_no_blocks(spark):
    rows = [(i, f"word{i} and some more words") for i in range(50)]
    plan = pieces.encode(table(spark, rows), piece_model())._jdf.queryExecution().executedPlan().toString()
    # Blocks are read as they lie; only questions and answers are dealt.
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert "Bucketed: true" in plan and sorted(dealt) == ["block", "bucket"]


def test_unigram_viterbi(spark):
    model = piece_model()
    model.kind, model.bytes = "unigram", {}
    model.rows = [("▁ab", 10, -3.0), ("▁", 11, -1.0), ("a", 12, -2.0), ("b", 13, -2.5), ("ab", 14, -1.5), ("bc", 15, -1.0), ("c", 16, -9.0)]
    units = spark.createDataFrame([(0, " ab"), (0, " abc"), (0, " abx"), (0, "c")], "bucket int, unit string")
    found = {r.unit: list(r.ids) for r in pieces.segment(units, model).collect()}
    assert found == {" ab": [11, 14], " abc": [11, 12, 15], " abx": [11, 14, model.unknown], "c": [16]}


@pytest.mark.parametrize("count", [2, 3, 10, 40])
def test_toxicity_of_few_labels(spark, count):
    """Any number of labels of both kinds gives a score for every text."""
    rows = [(i, "you are a stupid idiot" if i % 2 else "a calm day by the sea") for i in range(count)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(count)], "doc_id long, toxic int")
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(found) == len(rows) and all(0 <= f.score <= 1 and f.predicted == (f.score >= 0.3) for f in found)


def test_seventy_languages(spark):
    """Each language of a corpus is known, not only the commonest ones."""
    r = np.random.default_rng(12)
    rows = []
    for lang in range(70):
        words = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)]
        rows += [(100 * lang + i, " ".join(r.choice(words, 40)), f"l{lang}") for i in range(6)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bare = labelled.select("doc_id", "text", *(F.lit(None).cast("string").alias(c) for c in ("declared", "host", "suffix")))
    found = language_id.identify(bare, labelled).collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(found) == len(rows) and sum(truth[f.doc_id] == f.language for f in found) >= 0.97 * len(rows)
