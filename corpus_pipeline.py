"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars; other columns are dropped.

Every stage takes nulls in any column, empty and repeated rows and empty tables (no rows give no rows); what each makes of
them stands at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage
from strandline.llm.line_dedup import remove_repeated_lines
from strandline.llm.mixing import mix
from strandline.llm.near_dup import near_duplicates
from strandline.llm.packing import pack_documents
from strandline.llm.toxicity import fit_tables, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from the labelled rows that the split leaves for learning.
    A null text is judged as an empty one; repeated rows are judged alike, each for itself; a null doc_id doesn't matter.
    Columns pass through as they are."""
    scored = score(docs.select(*COLUMNS), fit_tables(spark, sf_dir), keep=COLUMNS)
    return scored.filter(F.col("score") < 0.5).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out. A document of which nothing but blanks is left held
    nothing of its own and goes; one that never held more stays, null texts among them. Repeated rows (one doc_id and text)
    are one document and stay or go together; null ids come first in order."""
    cut = remove_repeated_lines(docs.select(*COLUMNS))
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.filter(~F.coalesce(empty, F.lit(False))).select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, the one of the least doc_id (null last), so one of repeated rows.
    Texts without a word are no duplicates and all stay."""
    return near_duplicates(spark, docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that meet the targets of source, language and kind of content. Null
    sources and languages are values of their own; rows with one id, or with none, are kept or left out together."""
    return mix(spark, docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 4096 tokens. A null text counts as empty and takes one token; repeated rows
    are packed each for itself; a null doc_id stays null."""
    return pack_documents(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packing),
]

#: A fitted model, signatures and a tokenizer aren't SQL; tests/llm/test_pipeline.py holds the rows of run() against a
#: chain of plain Python versions of the stages (of packing all but the places, which are checked to be valid and as few
#: as the tokens need).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written to the shared folder and read again."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.write(docs, name)
            if k:
                stage.drop(STAGES[k - 1][0])
    return docs
