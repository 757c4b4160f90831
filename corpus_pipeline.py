"""From raw documents to packed training bins: four stages of the text operators in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylite.llm import jaccard_join, packing, pii, toxicity
from krylite.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go; all columns stay.

    Null and empty texts get the base score, so they stay unless most labelled documents are toxic. Each row is judged by
    its own text, also where ids repeat or are null; without labels of both kinds all rows get one score. An empty table
    gives no rows; columns of other names come through.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word Jaccard of 0.8 or more, the document with the smallest id stays; all columns stay.

    A null id always stays, and so do null and empty texts. Rows that repeat an id go or stay together, since ids name
    documents. An empty table gives no rows; columns of other names come through.
    """
    copies = jaccard_join.jaccard_classes(docs, n=5, percent=80).where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows, all other columns stay.

    Null texts stay null, empty ones empty. Each row is changed by its own text, also where ids repeat or are null. An
    empty table gives no rows; columns of other names come through.
    """
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go into bins of bounded size, no two of a source or duplicate cluster together: a row for each piece.

    Null and empty texts are pieces of length 0; null sources conflict with nothing. Rows that repeat are packed each for
    itself. An empty table gives no rows; other columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack),
]

#: No SQL: the first stage fits a classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
