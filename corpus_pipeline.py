"""The corpus pipeline: documents to packed training rows, in five stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labspark.llm import op2_mixing, op3_packing, op6_jaccard, op7_decontaminate, op8_quality
from labspark.session import materialise
from labspark.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below one half.

    Null and empty texts get the sample's share of label 1 and stay where that is half or
    more; long texts are scored whole; a tie at one half stays; repeated rows stay or go
    together. Without labels all stay; an empty table stays empty; columns may have any name.
    """
    model = op8_quality.fit(docs, table(spark, sf_dir, "labels").filter(~op8_quality.held_out()))
    return op8_quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    The one whose doc_id is smallest stays; a similarity of just 0.8 links. Null, empty and
    wordless texts are linked with nothing and stay; rows without a doc_id stay; of rows that
    repeat a doc_id one stays if any does. Long texts are compared whole; an empty table
    stays empty; other columns may have any name.
    """
    return op6_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item at a similarity of 0.8 or more.

    Null and empty texts hold none and stay; every window of a long text is looked at; a tie
    at 0.8 goes; repeated rows stay or go together. An empty benchmark drops nothing, an
    empty table stays empty; other columns may have any name.
    """
    return op7_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights, as rows of the words taken by document and epoch.

    Null, empty and wordless texts have nothing to draw and go; a null source is the last.
    Documents of one text tie by their place in the table, and repeated rows are drawn each.
    Long texts are cut where a block ends; an empty table stays empty; other columns may have
    any name.
    """
    return op2_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed texts into rows of token ids.

    Null and empty texts give their end id; long texts are split over rows without loss;
    pieces of one length go by their place in the table; repeated rows are packed each; an
    empty table gives no row; other columns are not read.
    """
    return op3_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", packing),
]

#: SQL can express none of the scoring, the sketches or the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{at}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
