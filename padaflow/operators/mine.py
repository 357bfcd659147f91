"""Mining of candidate terms that the lexicon doesn't know."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padaflow.functions import columns as C
from padaflow.functions import script
from padaflow.plans.engine import Engine

# Function words of Hindi and Sanskrit.
STOPWORDS = frozenset(
    "है हैं था थे थी और या तथा के का की को में से पर भी ही यह वह इस उस एक कि जो तो न नहीं "
    "लिए साथ द्वारा होता होती होते किया करें करते करना जाता जाती जाते गया गई हो रहा रही अपने "
    "च वा तु हि अपि इति एव सः सा तत् तस्य यस्य यत् न तथा च यथा अथ".split()
)
# Letters that legacy fonts leave behind.
ARTIFACTS = "ऩऱॊॆऻऺऄ"
SEGMENT = "[।॥.\n]+"


def garble_score(text: Column | str) -> Column:
    """The share of Devanagari words that begin with a vowel sign or hold a letter legacy fonts leave behind."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike("[ऀ-ॿ]"))
    bad = F.filter(words, lambda w: w.rlike("^[ा-ौॢॣ]") | w.rlike(f"[{ARTIFACTS}]"))
    return F.coalesce(F.try_divide(F.size(bad), F.size(words)), F.lit(0.0))


def segments(docs: DataFrame) -> DataFrame:
    """``docs(file, text)`` → file, segment, text."""
    return docs.select("file", F.posexplode(F.split(C.normalize_str("text"), SEGMENT)).alias("segment", "text"))


def _grams(longest: int, latin: bool):
    kind = pa.list_(pa.struct([("key", pa.string()), ("term", pa.string()), ("context", pa.string()), ("n", pa.int32()), ("at", pa.int32())]))

    def grams(text: str, entities: list[dict]) -> Iterator[dict]:
        covered = {i for e in entities for i in range(e["start"], e["end"])}
        own = [t for t in script.tokenize(text) if len(t.text) > 2 and (latin or not script.is_casual(t.text))]
        bad = [t.text in STOPWORDS or t.start in covered for t in own]
        for n in range(1, longest + 1):
            for i in range(len(own) - n + 1):
                part = own[i : i + n]
                if not any(bad[i : i + n]) and all(t.joinable for t in part[1:]):
                    context = text[max(0, part[0].start - 40) : part[-1].end + 40].strip()
                    yield {"key": " ".join(script.strict_key(t.text) for t in part), "term": " ".join(t.text for t in part), "context": context, "n": n, "at": i}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [list(grams(t or "", e or [])) for t, e in zip(b.column("text").to_pylist(), b.column("entities").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("file"), b.column("segment"), pa.array(out, kind)], names=["file", "segment", "grams"])

    return run


def mine(engine: Engine, docs: DataFrame, least: int = 3, longest: int = 3, latin: bool = False) -> DataFrame:
    """``docs(file, text)`` → term, iast, frequency, files, context of unknown n-grams seen at least ``least`` times.

    Grams are counted by key with map-side combining; the first occurrence (file, segment, place) gives the
    term and its context.
    """
    found = engine.annotate(segments(docs)).select("file", "segment", "text", F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("entities"))
    grams = found.mapInArrow(_grams(longest, latin), "file string, segment int, grams array<struct<key:string,term:string,context:string,n:int,at:int>>")
    grams = grams.select("file", "segment", F.explode("grams").alias("g")).select("file", "segment", "g.*")
    first = F.min(F.struct("file", "segment", "n", "at", "term", "context"))
    counted = grams.groupBy("key").agg(F.count("*").alias("frequency"), first.alias("first"), F.array_join(F.sort_array(F.collect_set("file")), ";").alias("files"))
    out = counted.where(F.col("frequency") >= least).orderBy(F.desc("frequency"), "first")
    return out.select(F.col("first.term").alias("term"), C.transliterate("first.term").alias("iast"), "frequency", "files", F.col("first.context").alias("context"), F.lit("").alias("label"))


def ngrams(docs: DataFrame, text: str = "text", longest: int = 3, shortest_word: int = 3) -> DataFrame:
    """doc_id, at, n, key of all runs of keys in plain Latin text, by built-in functions."""
    words = F.filter(C.words(text), lambda w: F.length(w) >= shortest_word)
    keys = docs.select("doc_id", F.transform(words, lambda w: C.fold(w)).alias("keys")).where("size(keys) > 0")
    run = lambda n: lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("keys", i + 1, F.lit(n)), " ").alias("key"))
    starts = lambda n: F.when(F.size("keys") >= n, F.sequence(F.lit(0), F.size("keys") - n)).otherwise(F.array().cast("array<int>"))
    every = F.concat(*(F.transform(starts(n), run(n)) for n in range(1, longest + 1)))  # runs are built before the explode, which so copies no document
    return keys.select("doc_id", F.explode(every).alias("r")).select("doc_id", "r.*")
