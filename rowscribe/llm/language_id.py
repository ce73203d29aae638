"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the likelihood of the text's letter
trigrams in each language, the language its markup declares (through how often
texts of a language declare what), and a prior from its host, which is smoothed
towards the prior of the address suffix, and that towards the corpus. Priors and
declaration rates are grouped sums over all documents. One more class,
``und``, gives every trigram one probability; a text it explains best is in no
known language.

Only the trigram tables are learned from labels, from at most ``SAMPLE`` rows.
Texts are read once and never shuffled: what is joined with the hosts is a row of
a few numbers, and a host of a third of all rows is split by the join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.llm.words import FOLD_CASE, byte_class, bytes_of, pieces
from rowscribe.session import cut

#: Bound on labelled rows the trigram tables are learned from, and on their languages (the commonest).
SAMPLE = 4_000
LANGUAGES = 512
BUCKETS = 1 << 16
#: Trigrams overlap and repeat; each counts for this share of an independent one, and a text for at most MOST.
SHARE, MOST = 0.3, 100.0
#: Rows a suffix's prior weighs in its host's, and the corpus's in its suffix's.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 200.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.005
ACCEPT = 0.5


def identify(rows: DataFrame, labelled: DataFrame, tables: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, text_key, declared, language, probability and accepted for every row.

    ``rows`` has doc_id, text, declared, host and suffix, ``labelled`` has text
    and lang. ``text_key`` is xxhash64 of the text. Null or empty evidence
    counts as none. A text without letters is ``und`` unless other evidence says
    more; a row is accepted if its language is known and at least ``ACCEPT``
    probable. Without labelled rows everything is ``und``. ``tables`` are the
    trigram tables of ``labelled``, if they are at hand. Other columns are not
    read.
    """
    text = F.col("text").cast("string")
    clean = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.lower(F.trim(F.col(c).cast("string"))))
    narrow = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), clean("declared").alias("declared"), clean("host").alias("host"), clean("suffix").alias("suffix"))
    names, table = tables or trigram_tables(labelled)
    count = len(names)
    if not count:
        return narrow.select("doc_id", F.xxhash64("text").alias("text_key"), "declared", F.lit(UNKNOWN).alias("language"), F.lit(1.0).alias("probability"), F.lit(False).alias("accepted"))
    packed = narrow.withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, declared string, host string, suffix string, fits array<double>"
    scored = cut(packed.mapInArrow(lambda b: _likelihoods(b, table), schema), "likelihoods")
    # What the text alone says, for priors and declaration rates; texts that say nothing are left out.
    fit = F.slice("fits", 1, count)
    certain = scored.withColumn("best", F.array_max(fit)).filter(F.col("best") > F.element_at("fits", count + 1))
    certain = certain.withColumn("own", F.array_position(fit, F.col("best")).cast("int") - 1)
    each = [F.sum((F.col("own") == i).cast("double")).alias(f"l{i}") for i in range(count)]
    sums = [F.col(f"l{i}") for i in range(count)]
    total = certain.agg(*each).first()
    seen = [float(total[f"l{i}"] or 0) + 1.0 for i in range(count)]
    corpus = F.array(*[F.lit(x / sum(seen)) for x in seen])

    def smoothed(counts, base, weight):
        n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, base, lambda c, b: (c + weight * b) / (n + weight))

    suffixes = certain.filter("suffix IS NOT NULL").groupBy("suffix").agg(*each).select("suffix", smoothed(F.array(*sums), corpus, F.lit(SUFFIX_WEIGHT)).alias("suffix_prior"))
    hosts = certain.filter("host IS NOT NULL").groupBy("host").agg(*each, F.min("suffix").alias("suffix")).join(suffixes, "suffix", "left")
    hosts = hosts.select("host", smoothed(F.array(*sums), F.coalesce("suffix_prior", corpus), F.lit(HOST_WEIGHT)).alias("host_prior"))
    said = certain.filter("declared IS NOT NULL").groupBy("declared").agg(*each)
    declaring = certain.filter("declared IS NOT NULL").agg(*each).first()
    rate = F.array(*[(c + F.when(F.col("declared") == name, 2.0).otherwise(0.02)) / (float(declaring[f"l{i}"] or 0) + 3.0) for i, (name, c) in enumerate(zip(names, sums, strict=True))])
    said = said.select("declared", rate.alias("rate"))
    flat = F.array(*[F.lit(1.0)] * count)
    joined = scored.join(hosts, "host", "left").join(suffixes, "suffix", "left").join(said, "declared", "left")
    prior = F.zip_with(F.coalesce("host_prior", "suffix_prior", corpus), F.coalesce("rate", flat), lambda p, r: F.log(p) + F.log(r))
    average = F.aggregate(F.zip_with(F.coalesce("rate", flat), corpus, lambda r, p: r * p), F.lit(0.0), lambda s, x: s + x)
    whole = F.concat(F.zip_with(prior, fit, lambda p, f: p + f), F.array(F.element_at("fits", count + 1) + F.log(F.lit(UNKNOWN_PRIOR)) + F.log(average)))
    out = joined.select("doc_id", "text_key", "declared", whole.alias("whole")).withColumn("top", F.array_max("whole"))
    probability = 1 / F.aggregate("whole", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    language = F.element_at(F.array(*map(F.lit, [*names, UNKNOWN])), F.array_position("whole", F.col("top")).cast("int"))
    out = out.select("doc_id", "text_key", "declared", language.alias("language"), probability.alias("probability"))
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("probability") >= ACCEPT))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of a documents table: its lang column is what was declared, its source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), none.alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of a pages table: text between tags, the html tag's lang, host and suffix of the address; doc_id is the page_id."""
    html = F.col("html").cast("string")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.regexp_replace(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"\.$", "")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return pages.select(F.col("page_id").alias("doc_id"), plain.alias("text"), declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def trigram_tables(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and, a column for each and one for ``und``, log probabilities of hashed trigrams; the last row is 0."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang")).filter("text IS NOT NULL AND lang != ''")
    total = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 30)) < min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    counts = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = cut(counts, "trigrams")
    by_size = [r.lang for r in found.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    names = sorted(by_size)
    if not names:
        return [], np.zeros((BUCKETS + 1, 1))
    got = found.filter(F.col("lang").isin(names)).toArrow()  # at most LANGUAGES x BUCKETS rows
    table = np.full((BUCKETS, len(names)), 0.5)
    place = {name: i for i, name in enumerate(names)}
    np.add.at(table, (got["bucket"].to_numpy(), np.array([place[x] for x in got["lang"].to_pylist()])), got["n"].to_numpy())
    table = np.log(table / table.sum(axis=0))
    used = len(np.unique(got["bucket"].to_numpy()))
    # und: even over twice as many trigrams as known languages use at all.
    unknown = np.full((BUCKETS, 1), -math.log(min(BUCKETS, 2 * used)))
    return names, np.concatenate([np.concatenate([table, unknown], axis=1), np.zeros((1, len(names) + 1))]).astype(np.float32)


_LETTERS = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_AS = np.where(_LETTERS, FOLD_CASE, 0x20).astype(np.uint32)


def _trigrams(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each byte the bucket of the trigram from there; BUCKETS where none starts."""
    out = np.full(len(data), BUCKETS, np.int32)
    if len(data) < 3:
        return out
    b = _AS[data]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    # A trigram with two spaces in a row says nothing.
    bucket[((b[:-2] == 0x20) & (b[1:-1] == 0x20)) | ((b[1:-1] == 0x20) & (b[2:] == 0x20))] = BUCKETS
    out[:-2] = bucket
    for back in (1, 2):
        ends = texts[1:] - back
        out[ends[(ends >= texts[:-1])]] = BUCKETS
    return out


def _counts(batches):
    for batch in pieces(batches):
        data, texts = bytes_of(batch.column("text"))
        grams = _trigrams(data, texts)
        langs = np.array(batch.column("lang").to_pylist(), object)
        each = np.repeat(np.arange(batch.num_rows), np.diff(texts))
        for lang in sorted(set(langs)):
            counts = np.bincount(grams[(langs == lang)[each]], minlength=BUCKETS + 1)[:BUCKETS]
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": counts[at]})


def _likelihoods(batches, table: np.ndarray):
    columns = np.ascontiguousarray(table.T)
    for batch in pieces(batches):
        data, texts = bytes_of(batch.column("text"))
        grams = _trigrams(data, texts)
        counts = np.diff(np.concatenate([[0], np.cumsum(grams < BUCKETS)])[texts])
        scale = np.minimum(SHARE, MOST / np.maximum(counts, 1))
        fits = np.empty((batch.num_rows, table.shape[1]))
        for i in range(table.shape[1]):
            total = np.concatenate([[0.0], np.cumsum(columns[i][grams], dtype=np.float64)])
            fits[:, i] = np.diff(total[texts]) * scale
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * table.shape[1], pa.int32()), pa.array(fits.ravel()))
        names = ["doc_id", "text_key", "declared", "host", "suffix"]
        yield pa.record_batch([*(batch.column(n) for n in names), lists], [*names, "fits"])
