"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal data, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a table; all but the last
keep the columns of documents. Stages handle null and empty texts as their operators say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import darts, flat, gam, leaks, pieces, pii
from gridloom.llm.links import Kept
from gridloom.llm.queries import PIECES, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier, fitted on the labelled rows, takes for good. Without any labels all rows stay."""
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = flat.fresh(docs, "_score")
    return gam.score(docs, model, name).where(F.col(name) >= 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id."""
    return darts.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, whatever its id."""
    return leaks.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, decoded: the pieces of every document, closed by the end id, and the text they give back."""
    encoded = pieces.encode(docs.select("doc_id", "text"), tokenizer(PIECES), decoded="decoded")
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("privacy", privacy), ("encoding", encoding)]

#: Classification, signatures and encoding have no SQL form. Tests compare privacy and encoding with plain Python and the
#: encoding library; the first three stages call operators that have brute-force tests (quality: held-out accuracy).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    kept, docs = Kept(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
