"""A corpus pipeline of five stages: toxicity, line dedup, MinHash near-dedup, PII and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.  A stage deletes its scratch
tables but those that the DataFrame it returns still reads.

In all stages an empty table gives an empty one, other columns stay as they are whatever their names, and a null
or empty text is kept (toxicity aside, where the score of an empty text decides, as for all).  Rows of a null
doc_id are never dropped as toxic or as copies; their lines and personal data are treated like all others'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, documents, side_join
from padaflow.llm.line_dedup import MIN_CHARS, drops, without_lines
from padaflow.llm.near_dedup import near_dedup
from padaflow.llm.pii import masked
from padaflow.llm.queries import packed
from padaflow.llm.toxicity import toxicity

#: SQL can express neither the classifier nor the tagger.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame, work: Scratch, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows of ``ids(doc_id)``, which is the last to read the tables of ``work``."""
    rejected = scratch.table(ids.distinct(), "rejected")
    work.clear()
    return side_join(docs, rejected, "doc_id", "left_anti").select(docs.columns)


def _sized(docs: DataFrame) -> DataFrame:
    """Renew n_chars, where there is one, after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.  Rows that share a doc_id go together; null texts score like empty ones."""
    work = Scratch(spark, "toxicity")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), work)
    return _without(docs, scored.where("predicted = 1").select("doc_id"), work, Scratch(spark, "toxic"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of similar lines go; a document that only held such lines goes with them.

    Texts that are shorter than a line of the fuzzy comparison stay whole, null and empty ones too.  Rows that
    share a doc_id are told apart by their text.
    """
    scratch = Scratch(spark, "lines")
    out = without_lines(docs, drops(docs, scratch), scratch)
    before = F.array_join("__lines", "\n")
    short = F.length(before) < MIN_CHARS
    emptied = F.coalesce((F.size("__gone") > 0) & (F.trim("text") == "") & ~short, F.lit(False))
    return _sized(out.where(~emptied).withColumn("text", F.when(short, before).otherwise(F.col("text"))).select(docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, similarity 0.8.

    Texts without words have no copies; rows that share a doc_id are one document.
    """
    work = Scratch(spark, "near")
    groups = near_dedup(docs, work, width=5, percent=80)
    return _without(docs, groups.where("NOT kept AND doc_id IS NOT NULL").select("doc_id"), work, Scratch(spark, "copies"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind.  Null text stays null; all rows stay."""
    return _sized(masked(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.  A null text counts as empty: its end token alone."""
    return packed(docs, Scratch(spark, "packing"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch, docs, before = Scratch(spark, "pipeline"), documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [name]
    return docs
