"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
all but the last return the columns of ``documents``, and any further ones that came with
them, whatever their names.  Rows are judged one by one, so repeated rows share their fate
(but for near copies, where one row stays).  A null id is an id like any other to all
stages but near copies, which never drop such rows.  Empty tables, of documents, labels or
items, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, jaccard, packing, quality, toxicity
from quarry.llm.common import Scratch, read


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null, empty and white-space texts are among them."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts score as clean and stay."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, and one row of it.

    Texts without words are copies of nothing and stay, as do rows with a null id.
    """
    return jaccard.keep_one(docs, Scratch(spark, "jaccard"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay."""
    return decontam.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "decontam"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into token windows; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("toxicity", filter_toxicity),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Learned models, connected components and packing have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
