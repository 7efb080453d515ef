"""A corpus from raw documents to tokens, in stages that each apply one operator.

Languages are identified and documents without one go; lines that ten documents share are dropped;
one document of each group of near-duplicates stays; sources are mixed to their target weights; what
is left is encoded. Every stage takes all its predecessor kept, is written to the shared folder as
Parquet, and is read again by the next one. All but the last keep the columns of ``documents``,
whatever others there are.

Null and empty texts have no language and go with the first stage. Each stage on its own takes them
as its operator does. Repeated rows are near-duplicates of each other; before that stage they count
as documents of their own. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane import session
from harborlane.llm import bpe, language, line_dedup, mixing, simhash
from harborlane.llm.common import held_out
from harborlane.llm.queries import VOCABULARY, digests


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; profiles are learned from the labelled ones."""
    out = held_out(F.col("doc_id"))
    model = language.learn(docs.where(language.learnable(out, "text", "lang")))
    found = language.predict(docs, model)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; their length is counted anew."""
    cleaned = line_dedup.drop_lines(docs)
    changed = F.col("dropped") > 0
    return cleaned.select(
        *[
            F.when(changed, F.col("kept")).otherwise(F.col("row.text")).alias("text")
            if name == "text"
            else F.when(changed, F.char_length("kept").cast("bigint"))
            .otherwise(F.col("row.n_chars")).alias("n_chars")
            if name == "n_chars"
            else F.col("row")[name].alias(name)
            for name in docs.columns
        ]
    )


def row_hash(docs: DataFrame):
    """Tells rows apart that have the same id; equal for rows that are equal throughout."""
    return F.xxhash64(*[F.col(f"`{name}`") for name in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Of rows with that id, one with the smallest hash stays, and one of rows that are all equal.
    """
    marked = docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("text"), row_hash(docs).alias("mark")
    )
    groups = simhash.near_duplicates(marked, "id", "text", keep=["id", "mark"])
    first = groups.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("null"), "id", "mark")).alias("_first")
    ).select(F.col("_first.id").alias("_id"), F.col("_first.mark").alias("_mark"))
    rows = docs.select(F.struct("*").alias("row"), row_hash(docs).alias("mark"))
    kept = rows.join(
        first, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    )
    return (
        kept.groupBy("_id", "_mark").agg(F.first("row").alias("row")).select("row.*")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number.

    Only the document at the end of a source's share is taken in part. The first document of a source
    that is taken in part is taken whole, so no source with words due to it goes. Documents without
    words are not taken.
    """
    return mixing.copies(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text they decode to."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    keep = ["doc_id", "lang", "source"]
    return digests(bpe.encode(docs, vocabulary, keep, decoded=True), [*keep, "ids"])


STAGES = [
    ("language", identify_language),
    ("lines", drop_shared_lines),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Hashes and trained profiles are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = session.fresh_dir(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
