"""Lexicon sources as DataFrames: CSV, JSON lines and term lists, projected to one entry schema.

Every reader gives ``raw`` columns of text plus where the row came from; :func:`entries` validates
and completes them.  Missing values are empty text or empty lists throughout.
"""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padaflow.functions import script

TEXT_COLUMNS = ("id", "label", "subtype", "canonical_iast", "devanagari", "synonyms", "hindi", "english", "definition", "botanical", "xrefs", "requires_context", "notes", "source")
LISTS = ("synonyms", "hindi", "english", "xrefs")
RAW = "row_ord bigint, " + ", ".join(f"{c} string" for c in TEXT_COLUMNS)
# Categories of term lists.
CATEGORIES = {
    "herbs": "DRAVYA", "herb": "DRAVYA", "dravya": "DRAVYA", "doshas": "DOSHA", "dhatus": "DHATU",
    "diseases": "ROGA", "symptoms": "SYMPTOM", "treatments": "PROCEDURE", "formulations": "FORMULATION",
}


class LexiconError(ValueError):
    """A lexicon file or row that can't be used."""


def _stem(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem


def _raw(df: DataFrame, source: str) -> DataFrame:
    """All raw columns, in file order; rows that are blank or whose id begins with # are dropped."""
    have = {c.lstrip("﻿").strip(): c for c in df.columns}
    cols = {c: F.coalesce(F.trim(F.col(f"`{have[c]}`").cast("string")), F.lit("")) if c in have else F.lit("") for c in TEXT_COLUMNS}
    out = df.select(F.monotonically_increasing_id().alias("row_ord"), *(v.alias(k) for k, v in cols.items()))
    out = out.where(~F.col("id").startswith("#") & (F.concat_ws("", *TEXT_COLUMNS) != ""))
    return out.withColumn("source", F.when(F.col("source") == "", F.lit(source)).otherwise(F.col("source")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8"), _stem(path))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lists are joined by |; ``canonical`` may stand for canonical_iast; null counts as missing."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("m"))
    listed = lambda c: F.coalesce(F.array_join(F.from_json(F.col("m")[c], "array<string>"), "|"), F.col("m")[c])
    cols = {c: listed(c) if c in LISTS else F.col("m")[c] for c in TEXT_COLUMNS} | {"canonical_iast": F.coalesce(F.col("m")["canonical_iast"], F.col("m")["canonical"])}
    return _raw(rows.select(*(v.alias(k) for k, v in cols.items())), _stem(path))


def read_terms(spark: SparkSession, path: str, categories: dict[str, str] | None = None, source: str | None = None) -> DataFrame:
    """``{"category": ["term", ...]}``; unknown categories become labels."""
    known = F.create_map(*(F.lit(x) for kv in (categories or CATEGORIES).items() for x in kv))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "terms"))
    terms = rows.select("category", F.explode("terms").alias("term")).where(F.trim("term") != "")
    deva = F.col("term").rlike(f"[{script.DEVANAGARI}]")
    label = F.coalesce(F.element_at(known, F.lower("category")), F.upper("category"))
    return _raw(terms.select(label.alias("label"), F.when(deva, F.col("term")).alias("devanagari"), F.when(~deva, F.col("term")).alias("canonical_iast")), source or _stem(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read a lexicon file by its extension."""
    kinds = {".csv": read_csv, ".jsonl": read_jsonl, ".json": read_terms}
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in kinds:
        raise LexiconError(f"unsupported lexicon file type: {path}")
    return kinds[suffix](spark, path)


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files in the order given, with ``file_ord``."""
    parts = [read(spark, p).withColumn("file_ord", F.lit(i)) for i, p in enumerate(paths)]
    if not parts:
        return spark.createDataFrame([], RAW + ", file_ord int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@F.pandas_udf(T.StringType())
def normalized(s: pd.Series) -> pd.Series:
    return s.map(script.normalize_str, na_action="ignore")


@F.pandas_udf(T.StringType())
def to_iast(s: pd.Series) -> pd.Series:
    return s.map(script.deva_to_iast, na_action="ignore")


@F.pandas_udf(T.StringType())
def to_deva(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if script.is_devanagari(x) else script.iast_to_deva(x), na_action="ignore")


@F.pandas_udf(T.StringType())
def full_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: script.strict_key(x, False), na_action="ignore")


def _list(c: str) -> Column:
    return F.filter(F.transform(F.split(F.col(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def _need(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + " in "), F.col("source"), F.lit(" row "), F.col("row_ord"))))


def entries(raw: DataFrame) -> DataFrame:
    """Validated entries, ids filled in and merged: of one id the last row counts, at the first one's place."""
    flag = F.lower("requires_context")
    context = F.when(flag.isin("", "no", "false", "0"), "").when(flag.isin("yes", "true", "1", "y"), "yes").when(flag == "compose", "compose")
    head = (F.col("canonical_iast") != "") | (F.col("devanagari") != "")
    weak = F.col("canonical_iast").startswith("~") | F.col("devanagari").startswith("~")
    raw = raw.withColumns({"canonical_iast": normalized("canonical_iast"), "devanagari": normalized("devanagari"), "synonyms": normalized("synonyms"), "hindi": normalized("hindi")})
    out = raw.withColumns(
        {
            "label": _need(F.col("label") != "", "row without label", F.upper("label")),
            "requires_context": F.coalesce(context, F.raise_error(F.concat(F.lit("invalid requires_context: "), "requires_context"))),
            "canonical": _need(head & ~weak, "missing or weak head form", F.when(F.col("canonical_iast") != "", F.col("canonical_iast")).otherwise(to_iast("devanagari"))),
            **{c: _list(c) for c in LISTS},
        }
    )
    out = out.withColumn("devanagari", F.when(F.col("devanagari") != "", F.col("devanagari")).otherwise(to_deva("canonical")))
    slug = F.when(full_key("canonical") == "", "x").otherwise(F.lower(full_key("canonical")))
    out = out.withColumn("id", F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lower("label"), F.lit(":"), slug)))
    fields = ["id", "label", "subtype", "canonical", "devanagari", "synonyms", "hindi", "english", "definition", "botanical", "xrefs", "requires_context", "notes", "source"]
    place = F.struct("file_ord", "row_ord")
    merged = out.groupBy("id").agg(F.max_by(F.struct(*fields), place).alias("e"), F.min(place).alias("place"))
    return merged.select("e.*", "place.file_ord", "place.row_ord")


ENTRY = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in LISTS else T.StringType()) for c in ("id", "label", "subtype", "canonical", "devanagari", "synonyms", "hindi", "english", "definition", "botanical", "xrefs", "requires_context", "notes", "source")])

# Labels whose single English words are specific enough without context.
SPECIFIC = ("ROGA", "FORMULATION", "PROCEDURE")


def surface_forms(lexicon: DataFrame, english: bool = True) -> DataFrame:
    """id, form_ord, text, weak, english: what each entry can be recognised by, first spelling of a case-insensitive form."""
    head = F.col("requires_context") != ""
    plain = lambda c: F.transform(c, lambda x: F.struct(x.alias("text"), F.lit(False).alias("weak"), F.lit(False).alias("english")))
    specific = F.col("label").isin(*SPECIFIC) | ((F.col("label") == "DRAVYA") & (F.col("subtype") == "herb"))
    heads = F.array(*(F.struct(F.col(c).alias("text"), head.alias("weak"), F.lit(False).alias("english")) for c in ("canonical", "devanagari")))
    foreign = F.transform("english", lambda x: F.struct(x.alias("text"), (~x.contains(" ") & ~specific).alias("weak"), F.lit(True).alias("english")))
    lists = [heads, plain("synonyms"), plain("hindi")] + ([foreign] if english else [])
    out = lexicon.select("id", "requires_context", F.posexplode(F.concat(*lists)).alias("form_ord", "f"))
    tilde = F.startswith(F.trim("f.text"), F.lit("~"))
    out = out.select("id", "form_ord", F.trim(F.when(tilde, F.substring(F.trim("f.text"), 2, 1 << 30)).otherwise(F.col("f.text"))).alias("text"), (F.col("f.weak") | tilde | (F.col("requires_context") == "compose")).alias("weak"), F.col("f.english").alias("english"))
    first = F.row_number().over(W.partitionBy("id", F.lower("text")).orderBy("form_ord"))
    return out.where("text != ''").withColumn("rn", first).where("rn = 1").drop("rn")


def labels(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("label").distinct()
