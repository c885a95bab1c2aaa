"""A corpus pipeline of five operators: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder and reads it
again for the next.  Every stage works on all that the one before kept.

Cases: rows are told apart by doc_id (null like any other value) and text, never by doc_id alone, so repeated and missing
ids lose no row but copies.  Null and empty texts are scored like an empty text, and are copies of each other; one of
them, if kept, contains no benchmark item and no personal data, and is packed as the end token alone.  Of copies the row
with the least id stays, ids before none.  Texts of any length go through whole.  Columns beside those of documents are kept up
to packing, whatever their names.  Without labels every row is kept by the first stage; without benchmark items every row by
the third; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rootloom.llm import decontaminate, packing, pii, quality, simhash_golay
from rootloom.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_golay.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


#: Learned models, graph components and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
