"""The corpus pipeline: raw documents to packed training sequences.

Each stage calls one training-data operator on all that the stage before kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoq.llm.common import materialise, table
from geoq.llm.decontaminate import drop_contaminated
from geoq.llm.jaccard_join import keep_one_of_each_class
from geoq.llm.line_dedup import remove_repeated_lines
from geoq.llm.packing import pack_documents
from geoq.llm.queries import TOXICITY_THRESHOLD, WORD_VOCABULARY, toxicity_model, vocabulary
from geoq.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return reject_toxic(docs, toxicity_model(spark, docs, sf_dir), TOXICITY_THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, but for their first occurrence; documents stay,
    with the length of the text that is left."""
    cut = remove_repeated_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of every document that is left."""
    return pack_documents(docs, vocabulary(WORD_VOCABULARY))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: The last stage needs a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
