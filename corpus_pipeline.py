"""Corpus pipeline: documents are filtered, cleaned and encoded, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a table that the caller writes
and reads again for the next one. All but the last keep the columns of ``docs``.
A stage finds its rows again by doc_id and text, so repeated doc_ids are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm import decontamination, language_id, near_dedup, pieces, surrogates
from rowscribe.llm.queries import SURROGATE_KEY, piece_model
from rowscribe.session import configure, cut

# Language identification, near duplicates, decontamination and encoding give no
# rows that SQL could compute, so the run is tested against plain Python.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and probable."""
    configure(spark)
    found = language_id.identify(language_id.document_evidence(docs), docs)
    rejected = found.filter(~F.col("accepted")).select("doc_id", "text_key").distinct()
    rejected = cut(rejected, "rejected")
    same = docs["doc_id"].cast("long").eqNullSafe(rejected["doc_id"]) & (F.xxhash64(docs["text"]) == rejected["text_key"])
    return docs.join(rejected, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id.

    Of rows that repeat doc_id and text one stays, and of texts that share a
    doc_id each is judged by itself; rows without doc_id all stay.
    """
    configure(spark)
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = cut(near_dedup.classes(docs).filter("doc_id != class_id").select("doc_id"), "classes")
        return docs.join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_anti")
    # Rows are told apart by doc_id and text; of a class the row of the least doc_id stays, of several the one of the least key.
    rows = docs.select(F.when(F.col("doc_id").isNotNull(), _key(docs)).alias("key"), "doc_id", "text")
    found = near_dedup.classes(rows.select(F.col("key").alias("doc_id"), "text")).filter("doc_id IS NOT NULL").distinct()
    named = found.join(rows.select(F.col("key").alias("doc_id"), F.col("doc_id").cast("long").alias("name")).distinct(), "doc_id")
    staying = cut(named.groupBy("class_id").agg(F.min(F.struct("name", "doc_id")).alias("best")).select(F.col("best.doc_id").alias("key")), "classes")
    kept = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    kept = kept.join(staying, _key(kept) == staying["key"], "left_semi")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that share a doc_id are judged one by one."""
    configure(spark)
    rows = docs.select(_key(docs).alias("doc_id"), "text")
    found = decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = cut(found.select("doc_id").distinct(), "contaminated")
    return docs.join(held, _key(docs) == held["doc_id"], "left_anti")


def _key(docs: DataFrame):
    """A hash of doc_id and text, which tell rows apart."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text."""
    configure(spark)
    clean = surrogates.replace_entities(docs, key=SURROGATE_KEY)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces and piece ids of every document, and whether they decode to its text."""
    configure(spark)
    model = piece_model()
    coded = pieces.decode(pieces.encode(docs, model), model)
    same = F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmarks),
    ("surrogates", personal_data),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
