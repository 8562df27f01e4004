"""A training corpus from documents: quality, toxicity, near-duplicates, packing.

Stages are called in order on all that the stage before kept; each result is written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.llm import common, jaccard, packing, quality, toxicity
from evgraph.llm.queries import labels, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more. A null text is an empty one; repeated rows share their
    fate; rows with a null doc_id are scored like any other; an empty table gives no rows; columns may have any names."""
    model = quality.fit_documents(docs, labels(spark, sf_dir))
    score = common.fresh(docs, "score")
    found = quality.score(docs, model, docs.columns, score)
    return found.filter(found[score] >= 0.5).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores under 0.5. Null texts, repeated rows, null doc_ids, empty tables and names of
    columns as in quality_stage."""
    lexicon = toxicity.fit_documents(docs, labels(spark, sf_dir))
    score = common.fresh(docs, "score")
    found = toxicity.score(docs, lexicon, docs.columns, (score, f"{score}_hits"))
    return found.filter(found[score] < 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles of a similarity of 0.8 or more): the smallest doc_id,
    a null one only where there is no other. Texts without words, null ones too, are one group; of repeated rows one
    stays; an empty table gives no rows; columns may have any names."""
    return jaccard.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens. A null text is empty and still a piece; repeated rows are
    packed each for itself; null doc_ids stay null; an empty table gives no rows; other columns are ignored."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]
#: Models fitted on labels and a packing plan have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = common.write_work(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
