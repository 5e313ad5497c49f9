"""Corpus pipeline over ``documents``, a part of the llm subpackage: each stage applies one of its operators.

language ID (rejects go) -> MinHash near-dedup (one document of each group stays) -> substring dedup (repeated
paragraphs go) -> PII (spans are masked) -> best-fit packing (pieces with their sequence and offset).

Every stage but the last returns the columns of ``documents``; all work on everything their predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm import common, language_id, minhash_dedup, packing, paragraph_dedup, pii
from inkspan.llm.common import cut, drop_cut, marked, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: a document goes if less than this share of its letters is in its language, or if it has no letter
MIN_SHARE = 0.4


_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose own files live until a later stage no longer reads them: at its start, what earlier stages wrote on
    the way and ``docs`` does not come from is deleted, so the disk holds what two neighbours need and not all five."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {x.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for x in docs.inputFiles()} if _left else set()
        for path in [p for p in _left if p.split(":", 1)[-1].lstrip("/") not in read]:
            common.remove_written(path)
            _left.remove(path)
        first = len(common._written)
        out = f(spark, docs, sf_dir)
        _left.extend(path for _, path in common._written[first:])
        return out

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without a main one, go; a null lang is filled with the prediction."""
    found = language_id.identify(docs, language_id.fit(docs), carry=("text", "lang", "source", "n_chars"))
    found = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SHARE))
    # written here, in small batches: the memory of an executor is what binds this pipeline
    return cut(found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS), "languages")


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays, once where its row is repeated; rows with
    a null id are in no group and stay."""
    found = minhash_dedup.near_duplicates(docs).filter("doc_id is not null")
    odd = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1")
    odd = cut(odd, "duplicates")
    # only what the bitmap of duplicates marks is shuffled; the other texts stay where they are
    d = marked(docs.select(*COLUMNS), "doc_id", odd)
    seen = d.filter("marked").drop("marked").join(odd, "doc_id", "left").filter("n is null or kept")
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c).asc_nulls_last() for c in COLUMNS[1:]])
    again = seen.filter("n > 1").withColumn("row", F.row_number().over(order)).filter("row = 1")
    return d.filter("not marked").select(*COLUMNS).unionByName(seen.filter("n is null").select(*COLUMNS)).unionByName(again.select(*COLUMNS))


@stage
def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = paragraph_dedup.remove_repeats(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.find_spans(docs, pii.fit(docs), mask=True, carry=("lang", "source"))
    return cut(out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS), "masked")


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_paragraphs),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the stages' methods; tests/llm holds them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(apply(spark, docs, sf_dir), name)
        if i:
            drop_cut(before)  # the successor is written
    return STAGES[-1][1](spark, docs, sf_dir)
