"""The corpus pipeline: language ID, toxicity, near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import byte_bpe, language_id, mixing, near_dup, toxicity
from tidegrid.llm.common import live, materialize, release, table

RANKS = "byte_bpe_50k.tiktoken"
BPE_BLOCK_CHARS = 5_000_000  # smaller than the operator's own, as workers of earlier stages still hold memory


def _whole(docs: DataFrame) -> F.Column:
    """A row with all its columns, so that no column of a stage clashes with one of the documents."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the languages that the stage learns from the rows it gets.

    Null texts, empty ones and those without a letter are in no language and go; so does text whose
    n-grams are no commoner in its language than by chance, and everything where no row has a
    language to learn.  Very long texts are read whole.  Equal texts fare alike and repeated rows
    keep a row each; an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    model = language_id.fit(docs.where(~language_id.held_out(4, 2)).select("doc_id", "text", "lang"))
    said = language_id.predict(docs.select(_whole(docs), "text"), model)
    return said.where(language_id.is_known(F.col("lang_pred"), F.col("likeness"), F.col("text"))).select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the stage's own model, learned from labelled rows it gets, calls clean.

    Null and empty texts are judged by their zero features; without labelled rows of both classes
    all rows get the share of toxic labels as their score.  Other cases as in the stage before.
    """
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(_whole(docs), "text"), model).where("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The one with the smallest doc_id stays (of several texts with that doc_id one by its hash, of
    repeated rows any).  Texts without words, null ones too, all stay.  Very long texts are compared
    whole; an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    return near_dup.dedup(docs, width=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say.

    Texts without words, null ones too, have no tokens and stay once, as do all rows where no row is
    labelled.  Other cases as in the stage before, but that repeated rows count each.
    """
    return mixing.mix_rows(docs, mixing.domains_of(table(spark, sf_dir, "labels")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row for each row.

    Null texts are empty and have no tokens; very long ones are encoded whole; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    return byte_bpe.encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, BPE_BLOCK_CHARS)


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_domains),
    ("byte_bpe", encode_tokens),
]

#: Learned models and MinHash candidates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written to the shared folder and read again.

    Once a stage is written, the tables that it was made from are deleted.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = {path for path in live if live[path] is not docs}
        docs = materialize(stage(spark, docs, sf_dir))
        release(*[made for path, made in list(live.items()) if path not in before and made is not docs])
    return docs
