"""Reports over annotated documents: metrics, histograms, rows, highlights, lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(docs: DataFrame, entities: str = "entities") -> DataFrame:
    """One row per entity of ``docs(doc_id, entities)``; components are joined by `` + ``."""
    rows = docs.select("doc_id", F.posexplode(entities).alias("ord", "e")).select("doc_id", "ord", "e.*")
    return rows.withColumn("components", F.array_join(F.transform("components", lambda c: c["canonical"]), " + ")) if "components" in rows.columns else rows


def metrics(rows: DataFrame) -> DataFrame:
    """Entities, labels, ambiguous entities and mean confidence (0 without entities)."""
    return rows.agg(F.count("*").alias("entities"), F.countDistinct("label").alias("labels"), F.coalesce(F.sum(F.col("ambiguous").cast("bigint")), F.lit(0)).alias("ambiguous"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def by_label(entities: Column | str, label: str) -> Column:
    return F.filter(entities, lambda e: e["label"] == label)


def only(entities: Column | str, labels: list[str] | None = None, least: float = 0.0) -> Column:
    """Entities of the labels (all, if none are given) and at least that confident."""
    wanted = [x.upper() for x in labels or []]
    return F.filter(entities, lambda e: (e["confidence"] >= least) & (e["label"].isin(wanted) if wanted else F.lit(True)))


def highlight(text: str, entities: str, before: str = "[", after: str = "]") -> Column:
    """The text with every entity in brackets, its label behind it.  Entities are in order and don't overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, e: Column) -> Column:
        gap = F.substring(F.col(text), a["at"] + 1, e["start"] - a["at"])
        span = F.substring(F.col(text), e["start"] + 1, e["end"] - e["start"])
        return F.struct(F.concat(a["out"], gap, F.lit(before), span, F.lit("|"), e["label"], F.lit(after)).alias("out"), e["end"].alias("at"))

    return F.aggregate(entities, start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))


def entry_by_id(lexicon: DataFrame, entry_id: str) -> DataFrame:
    return lexicon.where(F.col("id") == entry_id)


def bare(c: Column | str) -> Column:
    """A list of forms without their weak marks."""
    return F.transform(c, lambda x: F.regexp_replace(x, "^~+", ""))


def within_limits(text: Column | str, most_chars: int = 100_000) -> Column:
    return F.length(text) <= most_chars
