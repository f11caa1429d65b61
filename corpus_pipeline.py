"""Corpus pipeline: quality, near copies, benchmark passages, secrets, tokens. Each stage reads what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patrolkit.llm import decontaminate, quality, secret_scan, sentencepiece_bpe, simhash
from patrolkit.llm._shared import free_name, scratch, written
from patrolkit.llm.queries import table, tokenizer_path

#: SQL cannot express the classifier, the fingerprints and the tokens.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the stage's own input and the labels.

    A null text counts as empty and is scored like any other; repeated rows are judged alike; rows without an id stay
    rows; without labels of both kinds every document gets the share of good labels; an empty table stays empty.
    """
    model = quality.fit_on_tables(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, name=free_name(docs.columns, "score"))
    return scored.where(F.col(f"`{scored.columns[-1]}`") >= quality.CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, once, however often it is repeated.

    Null and empty texts have no words and are copies of each other; a group whose documents all lack an id keeps one.
    """
    return simhash.one_of_each(docs)


def untested_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a window of a benchmark item.

    Null texts have no words and stay; repeated rows are judged alike; an empty benchmark keeps every document.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = found.columns[len(docs.columns) + 1]
    return found.where(F.col(f"`{hit}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and the number of characters counted anew.

    Null texts stay null with the count they had; overlapping spans get one mark; rows and other columns stay.
    """
    clean = secret_scan.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with digests of the ids and of the decoded text.

    A null text counts as empty: begin and end only. Repeated rows and rows without an id stay rows.
    """
    coded = sentencepiece_bpe.tokens(docs.select("doc_id", "text"), tokenizer_path(), keep_text=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("benchmark decontamination", untested_documents),
    ("secret scans", redacted_documents),
    ("SentencePiece encoding and decoding", token_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again.

    What a stage leaves besides its rows is removed when the rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():
            docs = written(stage(spark, docs, sf_dir), f"stage{place}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
