"""Toxicity: boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are rates a reader could name: words of a fixed and of a learned
lexicon, hits near a second-person word, capitals, punctuation and disguised
words. All of a batch's texts are measured at once in numpy. Labels are learned
from at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id; the learned
lexicon comes from one part of them, the trees from another and the calibration
from a third, so no part judges what it has learned. Features are written once
and used for training and for scoring, so no text is read again by the trees.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.llm.words import ALPHANUMERIC, FOLD_CASE, byte_class, hash_ranges, pieces, words_of
from rowscribe.session import cut

#: Bound on labelled rows that are used.
SAMPLE = 20_000
#: Bound on learned lexicon entries.
ENTRIES = 2_000
#: Bytes of a word's start that may stand for it in the learned lexicon; 0: the whole word.
STARTS = (0, 4, 5, 6, 7, 8)
#: Insults in the corpus's languages, second-person words.
INSULTS = (
    "idiot idiots moron morons stupid clown clowns pathetic worthless disgusting trash scum loser losers garbage filth vermin imbecile dumb dumbass jerk "
    "bastard bitch asshole crap shit fuck fucking bullshit creep pig freak retard hate kill ugly liar coward parasite "
    "idiota estúpido imbécil basura asqueroso inútil patético mierda cabrón "
    "idiote crétin débile ordure dégoûtant minable pathétique merde connard salope abruti "
    "dumm dummkopf trottel abschaum ekelhaft wertlos erbärmlich müll scheiße arschloch schwein versager"
).split()
SECOND_PERSON = "you your yours yourself u ur ya tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch usted ustedes vosotros tú ti".split()
NEAR = 5
#: Signs that stand for letters in disguised words.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = [
    "length", "insults", "insult_count", "learned", "learned_strong", "learned_most", "near_second_person",
    "capitals", "shouted", "punctuation", "exclaimed", "disguised", "disguised_insults",
]


#: Which tenths of the labelled rows the trees and the calibration curve are fitted on.
LEARNED, CALIBRATED = "part BETWEEN 4 AND 7 OR part = 0", "part >= 8"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.3), a row for each row of ``docs``.

    Rows whose crc32 of doc_id as text leaves 2 modulo 4 are held out: their
    labels are never read. A null text counts as empty; a null doc_id is not held
    out and has no label. Labels other than 0 and 1 are ignored, the larger of
    several for a doc_id counts. If the rows that the trees learn from are not of
    both kinds, every score is the mean of the labels used (0 without labels); if
    those kept for calibration are not, the trees' probabilities are the scores.
    """
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    known = known.filter(remainder != 2).withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    count = known.count()
    sample = cut(known.filter(F.col("place") < min(1.0, SAMPLE / max(count, 1)) * (1 << 30)).withColumn("part", F.pmod(F.col("place"), F.lit(10))), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    lexicon = learned_lexicon(texts.join(F.broadcast(sample.filter("part < 4")), "doc_id"))
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    features = cut(texts.mapInArrow(lambda batches: _features(batches, lexicon), schema), "features")
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    learned = {r.toxic for r in sample.filter(LEARNED).select("toxic").distinct().collect()}
    calibrated = {r.toxic for r in sample.filter(CALIBRATED).select("toxic").distinct().collect()}
    if len(learned) < 2:
        mean = kinds.get(1.0, 0) / max(sum(kinds.values()), 1)
        scored = features.select("doc_id", held_out, F.lit(float(mean)).alias("score"))
    else:
        raw = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = raw.transform(features.join(F.broadcast(sample), "doc_id")).select("features", "toxic", "part")
        model = GBTClassifier(labelCol="toxic", maxIter=30, maxDepth=4, stepSize=0.15, seed=7, maxBins=64).fit(train.filter(LEARNED))
        margin = vector_to_array("probability")[1].alias("margin")
        judged = model.transform(raw.transform(features)).select("doc_id", margin)
        if len(calibrated) < 2:
            judged = judged.withColumnRenamed("margin", "score")
        else:
            curve = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score").fit(model.transform(train.filter(CALIBRATED)).select(margin, "toxic"))
            judged = curve.transform(judged)
        scored = judged.select("doc_id", held_out, F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def learned_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and weights of word starts far commoner in toxic rows; at most ``ENTRIES``."""
    counted = rows.mapInArrow(_presence, "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = rows.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).first()
    n, m = float(totals.toxic or 0), float(totals.other or 0)
    odds = F.log((F.col("toxic") + 0.5) / (n + 1.0)) - F.log((F.col("other") + 0.5) / (m + 1.0))
    # A weight counts by how surely it is one: its rate of toxic rows times its odds.
    chosen = counted.filter("toxic >= 3").withColumn("weight", odds).filter("weight > 0.7").orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "key").limit(ENTRIES).collect()
    chosen.sort(key=lambda r: r.key & 0xFFFFFFFFFFFFFFFF)
    return np.array([r.key & 0xFFFFFFFFFFFFFFFF for r in chosen], np.uint64), np.array([r.weight for r in chosen])


def _presence(batches):
    for batch in batches:
        words = words_of(batch.column("text"), ALPHANUMERIC, FOLD_CASE, hashes=False)
        label = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False) > 0.5, np.diff(words.first))
        text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        found = []
        for keys in _keys(words):
            order = np.lexsort((text, keys))
            k, t = keys[order], text[order]
            once = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if len(k) else np.zeros(0, bool)
            k, toxic = k[once], label[order][once]
            heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            if len(heads):
                found.append((k[heads], np.add.reduceat(toxic.astype(np.int64), heads), np.diff(np.concatenate([heads, [len(k)]]))))
        if found:
            key, toxic, count = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch({"key": key.view(np.int64), "toxic": toxic, "other": count - toxic})


def _keys(words) -> list[np.ndarray]:
    """For each of STARTS a hash of each word's start; the length is part of it."""
    ends = [words.ends, *(np.minimum(words.starts + n, words.ends) for n in STARTS if n)]
    return [h ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)) for n, h in zip(STARTS, hash_ranges(words.data, words.starts, ends, FOLD_CASE), strict=True)]


@cache
def _fixed():
    of = lambda texts: np.sort(words_of(pa.array(texts), ALPHANUMERIC, FOLD_CASE).hashes)
    disguise = FOLD_CASE.copy()
    for sign, letter in SIGNS.items():
        disguise[ord(sign)] = ord(letter)
    signed = ALPHANUMERIC.copy()
    signed[[ord(s) for s in "@$!*"]] = True
    letters = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
    signs = byte_class([(ord(s), ord(s)) for s in "0134579@$!*"])
    return of(INSULTS), of(SECOND_PERSON), disguise, signed, letters, signs


def _features(batches, lexicon):
    insults, second, disguise, signed, letters, signs = _fixed()
    keys, weights = lexicon
    capital, small = byte_class([(0x41, 0x5A)]), byte_class([(0x61, 0x7A)])
    marks = byte_class([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
    for batch in pieces(batches):
        words = words_of(batch.column("text"), ALPHANUMERIC, hashes=False)
        hashes = _keys(words)
        n = np.maximum(np.diff(words.first), 1).astype(float)
        per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=float)])[words.first])
        size = np.maximum(np.diff(words.texts), 1).astype(float)
        per_byte = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[words.data], dtype=np.int64)])[words.texts])
        hit = np.isin(hashes[0], insults)
        weight = np.zeros(len(words.starts))
        if len(keys):
            for h in hashes:
                slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                weight = np.maximum(weight, np.where(keys[slot] == h, weights[slot], 0.0))
        strong = weight >= 2.0
        you = np.concatenate([[0], np.cumsum(np.isin(hashes[0], second))])
        place = np.arange(len(hit))
        text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        low, high = np.maximum(place - NEAR, words.first[:-1][text]), np.minimum(place + NEAR + 1, words.first[1:][text])
        near = (hit | strong) & (you[high] > you[low])
        most = np.zeros(batch.num_rows)
        np.maximum.at(most, text, weight)
        upper = np.concatenate([[0], np.cumsum(capital[words.data])])
        shouted = (upper[words.ends] - upper[words.starts] == words.ends - words.starts) & (words.ends - words.starts > 1)
        lettered = np.maximum(per_byte(capital) + per_byte(small), 1)
        # Disguised words: signs between letters of one word.
        odd = words_of(batch.column("text"), signed, disguise)
        spell = np.concatenate([[0], np.cumsum(letters[odd.data])])
        sign = np.concatenate([[0], np.cumsum(signs[odd.data])])
        mixed = np.zeros(len(odd.starts), bool)
        if len(mixed):
            inner = odd.ends - odd.starts > 2
            mixed = inner & (sign[np.maximum(odd.ends - 1, odd.starts)] - sign[np.minimum(odd.starts + 1, odd.ends)] > 0) & (2 * (spell[odd.ends] - spell[odd.starts]) >= odd.ends - odd.starts)
        per_odd = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=float)])[odd.first])
        columns = {
            "length": np.log1p(n), "insults": per_text(hit) / n, "insult_count": np.log1p(per_text(hit)),
            "learned": per_text(weight) / n, "learned_strong": per_text(strong) / n, "learned_most": most, "near_second_person": per_text(near) / n,
            "capitals": per_byte(capital) / lettered, "shouted": per_text(shouted) / n, "punctuation": per_byte(marks) / size,
            "exclaimed": per_byte(byte_class([(0x21, 0x21), (0x3F, 0x3F)])) / size, "disguised": per_odd(mixed) / n,
            "disguised_insults": per_odd(mixed & np.isin(odd.hashes, insults)) / n,
        }
        yield pa.record_batch({"doc_id": batch.column("doc_id")} | columns)
