"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

Each stage takes the columns of documents and, but for the last, returns them. run() writes every stage's result to the
folder that executors share and reads it again for the next one, so a lost executor never costs more than one stage; the
table before it is deleted then.

Defined cases, alike in all stages: an empty table gives an empty table. A null text counts as an empty one and stays null
up to packing, where it is the end id alone; it has no words, so mixing never takes it. Rows of a null doc_id are
documents of their own that take no part in line dedup and near-dedup. Rows that repeat (doc_id and text) are one
document to line dedup; near-dedup keeps one row of them, and of different texts under one doc_id the one of least hash.
Null source and lang are values of their own. Ties go to the smaller doc_id. Columns beyond those of documents are dropped
by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrail.llm import line_dedup, mixing, near_dup, packing, quality_classifier
from embertrail.llm.common import cut, drop

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(quality_classifier.classify(docs, labels).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated runs of lines; a document all of whose lines go goes too."""
    out = line_dedup.remove_repeats(docs)
    return _documents(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    found = near_dup.deduplicate(docs, shingle=5, percent=80).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("_gone"), F.count("*").alias("_rows"), F.max("n_shingles").alias("_most"))
    ids = cut(ids.where("_gone or (_rows > 1 and _most > 0)").select(F.col("doc_id").alias("_id"), "_gone"), "gone")
    docs = docs.select(*COLUMNS)
    once = docs.join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left_anti")
    if not ids.where("not _gone").take(1):
        return _documents(once)
    # A doc_id that stays and stands in several rows: one of them, the empty ones aside.
    again = docs.join(ids.where("not _gone").hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    some = F.struct((mixing.word_count(F.col("text")) == 0).alias("_e"), F.xxhash64("text").alias("_h"), *[c for c in COLUMNS if c != "doc_id"])
    again = again.groupBy("doc_id").agg(F.min(some).alias("_row")).select("doc_id", "_row.*")
    return _documents(once.select(*COLUMNS).unionByName(again.select(*COLUMNS)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: as many whole copies of a document as it is taken, and its first words for the rest.

    Rows that share a doc_id, source and size share what they are taken equally; what does not divide is taken from one
    of them, the least text.
    """
    mixed, _ = mixing.mix(docs)
    per = mixed.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("_t"), F.count("*").alias("_n"))
    per = cut(per.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"), F.expr("_t div _n").alias("_taken"), F.expr("_t % _n").alias("_left")).where("_taken > 0 or _left > 0"), "taken")
    own = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("_w"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_w") == F.col("_size"))
    taken = own.join(per.where("_taken > 0").hint("merge"), on).select(*COLUMNS, "_size", "_taken")
    rest = per.where("_left > 0")
    if rest.take(1):
        least = own.join(rest.hint("merge"), on).groupBy("_id", "_src", "_size").agg(F.min(F.struct("text", "lang")).alias("_row"), F.first("_left").alias("_taken"))
        least = least.select(F.col("_id").alias("doc_id"), "_row.text", "_row.lang", F.col("_src").alias("source"), F.lit(None).cast("long").alias("n_chars"), "_size", "_taken")
        taken = taken.unionByName(least)
    copies = taken.withColumn("_k", F.explode(F.expr("sequence(0L, (_taken - 1) div _size)")))
    part = F.col("_taken") - F.col("_k") * F.col("_size")
    text = F.when(part >= F.col("_size"), F.col("text")).otherwise(mixing.word_slice(F.col("text"), part))
    return _documents(copies.withColumn("text", text))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing", mixture), ("packing", pack)]

#: SQL cannot express the trained classifier, the signatures or the tokenizer; the tests hold run() against its parts.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = cut(out, f"stage{i}")
            drop(docs)  # nothing reads it any more
        docs = out
    return docs
