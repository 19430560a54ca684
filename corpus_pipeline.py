"""A training corpus from ``documents``: filtered, deduplicated, decontaminated and encoded.

Each stage reads what its predecessor kept.  All but the last return the columns of ``documents``;
the last returns (doc_id, ids).  No SQL expresses the classifiers, so there is no ORACLE_SQL.  No
documents give no rows at any stage; ``docs`` may have further columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.decontaminate import drop_contaminated
from lumenframe.llm.nearcopies import keep_one_of_each
from lumenframe.llm.pieces import encode_pieces
from lumenframe.llm.quality import keep_good
from lumenframe.llm.queries import PIECE_MODEL
from lumenframe.llm.storage import Table, table
from lumenframe.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents predicted as low quality go.

    Every row is judged by its own text, repeated ones each, null and empty texts as one empty passage.
    Where no labelled document is among ``docs`` nothing goes.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted as toxic go.

    Every row is judged by its own text, repeated ones each, null, empty and wordless texts by the
    intercept alone.  Where no labelled document is among ``docs`` nothing goes.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 at a shingle similarity: of each class of near copies (Jaccard 0.8 of five words) the smallest doc_id stays.

    Null, empty and wordless texts are one class.  Of repeated rows and of rows with one doc_id and text,
    and of a class without any doc_id, the first one read stays.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: contaminated documents go, each row by its own text, those without doc_id too.

    Null, empty and wordless texts stay, and repeated rows that aren't contaminated.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), keep_without_id=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: a reproducible sampled segmentation of each document.

    Null and empty texts have no pieces; repeated rows get the same ones; a null doc_id samples as key 0.
    """
    return encode_pieces(docs, PIECE_MODEL)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
