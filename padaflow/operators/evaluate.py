"""Evaluation against gold spans, set-wise over (doc_id, start, end, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = ["doc_id", "start", "end", "label"]


def locate(gold: DataFrame) -> DataFrame:
    """``gold(doc_id, text, entities array<array<string>>)`` → SPAN rows, found from left to right.

    A surface that isn't found after the last one is looked for from the start; one not found at all is an error.
    """

    def step(a: Column, e: Column) -> Column:
        ahead = _find(e[0], a["at"])
        at = F.when(ahead > 0, ahead).otherwise(_find(e[0], F.lit(0)))
        at = F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("gold surface not found: "), e[0])).cast("int")) - 1
        span = F.struct(at.alias("start"), (at + F.length(e[0])).alias("end"), e[1].alias("label"))
        return F.struct(F.concat(a["out"], F.array(span)).alias("out"), (at + F.length(e[0])).alias("at"))

    def _find(surface: Column, start: Column) -> Column:
        return F.call_function("locate", surface, F.col("text"), start + 1)

    zero = F.struct(F.array().cast("array<struct<start:int,end:int,label:string>>").alias("out"), F.lit(0).alias("at"))
    spans = F.aggregate("entities", zero, step, lambda a: a["out"])
    return gold.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")


def exact(gold: DataFrame, predicted: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn of distinct spans, by columns both sides share (default: label)."""
    by = by or ("label",)
    side = lambda df, c: df.select(*dict.fromkeys([*SPAN, *by]), F.lit(1).alias(c)).distinct()
    keys = list(dict.fromkeys([*SPAN, *by]))
    both = side(gold, "g").join(side(predicted, "p"), keys, "full")
    count = lambda ok, name: F.count(F.when(ok, 1)).alias(name)
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return both.groupBy(*by).agg(count(g & p, "tp"), count(~g & p, "fp"), count(g & ~p, "fn"))


def overlap(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp and fn by label; each gold span, in order, takes the first free prediction that overlaps it with its label."""
    pack = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias(name))
    docs = pack(gold, "g").join(pack(predicted, "p"), "doc_id", "full")
    kind = "array<struct<start:int,end:int,label:string>>"
    docs = docs.select("doc_id", *(F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c in "gp"))
    fits = lambda p, g: (p["label"] == g["label"]) & (p["start"] < g["end"]) & (g["start"] < p["end"])
    zero = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<label:string,hit:boolean>>").alias("out"))

    def step(a: Column, g: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: fits(F.element_at("p", i), g) & ~F.array_contains(a["used"], i))
        first = F.when(F.size("p") > 0, F.try_element_at(free, F.lit(1)))
        used = F.when(first.isNull(), a["used"]).otherwise(F.concat(a["used"], F.array(first)))
        return F.struct(used.alias("used"), F.concat(a["out"], F.array(F.struct(g["label"].alias("label"), first.isNotNull().alias("hit")))).alias("out"))

    done = docs.select("p", F.aggregate("g", zero, step).alias("a"))
    golds = done.select(F.explode("a.out").alias("o")).select("o.label", F.col("o.hit").cast("int").alias("tp"), F.lit(0).alias("fp"), (~F.col("o.hit")).cast("int").alias("fn"))
    spare = F.filter(F.transform("p", lambda p, i: F.struct(p["label"].alias("label"), (i + 1).alias("i"))), lambda x: ~F.array_contains("a.used", x["i"]))
    rest = done.select(F.explode(spare).alias("o")).select("o.label", F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    return golds.union(rest).groupBy("label").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")))


def with_micro(counts: DataFrame) -> DataFrame:
    """Counts by label and, with a null label, over all."""
    return counts.rollup("label").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def mismatches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, missed and spurious (sorted start:end:label) where the sides differ."""
    name = F.concat_ws(":", "start", "end", "label")
    missed = gold.select(*SPAN).subtract(predicted.select(*SPAN)).select("doc_id", name.alias("missed"), F.lit(None).cast("string").alias("spurious"))
    spurious = predicted.select(*SPAN).subtract(gold.select(*SPAN)).select("doc_id", F.lit(None).cast("string").alias("missed"), name.alias("spurious"))
    each = lambda c: F.array_join(F.sort_array(F.collect_list(c)), " ").alias(c)
    return missed.union(spurious).groupBy("doc_id").agg(each("missed"), each("spurious"))
