"""From documents to packed training sequences: quality, exact copies, near copies, benchmark leaks, packing.

Each stage works on what the one before it kept, read again from Parquet; all but the last return the columns of
documents.

Every stage takes null ids and texts, repeated ids, empty tables and columns of any further name. A null text is an empty
one. Rows are judged one by one: of rows that share an id, or have none, one may go and another stay. Rows that repeat an
id and a text are copies, and one stays; of equal texts the longest as written, then the smallest id, stays; of near copies
one row of each group stays, whichever has the smallest row key (a hash of id and text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewise.llm import decontaminate as leaks
from tidewise.llm import exact_dedup as exact
from tidewise.llm import minhash_dedup as near
from tidewise.llm import packing, quality
from tidewise.llm.store import spare, table, with_row_key, without, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one; also of rows that repeat one document's id and text."""
    rows = exact.exact_dedup(docs)
    pairs = written(rows.groupBy("id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1"), "dropped-copies")
    plain = written(pairs.groupBy("id").agg(F.max(F.col("stays") | F.col("id").isNull()).alias("some")), "dropped-ids")
    once = without(docs, plain.where("not some").select("id"), "doc_id")
    mixed = plain.where("some").select("id")
    if mixed.isEmpty():
        return once
    # an id with copies and other texts, or repeated rows: its rows are told apart by their digests
    other, digest, gone, nth = (spare(docs, c) for c in ("other_id", "digest", "gone", "nth"))
    same = F.col("doc_id").eqNullSafe(F.col(other))
    mixed = mixed.withColumnRenamed("id", other)
    rest = once.join(mixed, same, "left_semi").withColumn(digest, exact.sha256(exact.normalised(F.col("text"))))
    dropped = pairs.where("not stays").select(F.col("id").alias(other), F.col("digest").alias(gone))
    rest = rest.join(dropped, same & (F.col(digest) == F.col(gone)), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.char_length(F.coalesce("text", F.lit(""))).desc(), "text"))
    return once.join(mixed, same, "left_anti").unionByName(rest.withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    rows, key = with_row_key(docs, "doc_id", "text")
    found = near.near_duplicates(rows, id_col=key, width=5, percent=80)
    return without(rows, found.where(~F.col("kept")).select("id"), key).drop(key)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark passage."""
    rows, key = with_row_key(docs, "doc_id", "text")
    found = leaks.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return without(rows, found.where("contaminated").select("id"), key).drop(key)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences with their places in packed sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer=packing.public_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_first_copies),
    ("near-duplicate dedup", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("best-fit packing", pack_sequences),
]

#: Trained scores, signatures and token ids are not expressible in SQL; a brute-force version tests the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
