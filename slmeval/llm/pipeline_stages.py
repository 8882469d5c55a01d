"""The stages of the corpus pipeline: each applies one operator to the documents it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, mixing, queries, simhash
from .common import fresh_names, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells: those without a letter or with a margin too
    narrow go. Learned as in the query, from four fifths of the documents."""
    prepare(spark)
    pred, score, ok = fresh_names(docs, "pred", "score", "ok")
    found = langid.identify(docs, queries.language_dictionaries(docs), lang=pred, score=score, accepted=ok)
    return found.filter(F.col(ok)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    prepare(spark)
    return simhash.keep_one(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the digests of ids and decoded bytes."""
    prepare(spark)
    return queries.encoded(docs, ["doc_id", "lang", "source"])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near-duplicates of an earlier line go; documents left without any go too."""
    prepare(spark)
    return lines.drop_duplicate_lines(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words."""
    prepare(spark)
    return mixing.mixed_documents(docs)
