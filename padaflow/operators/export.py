"""Exports of annotated documents: JSON lines, CoNLL/BIO and annotation tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padaflow.functions import script

FORMATS = {"jsonl": "jsonl", "conll": "conll", "bio": "conll", "tsv": "conll", "json": "tasks", "labelstudio": "tasks", "label_studio": "tasks"}


def json_lines(docs: DataFrame) -> DataFrame:
    """value: one JSON object per document; missing metadata keys are left out."""
    return docs.select(F.to_json(F.struct("text", "entities", "lexicon_version")).alias("value"))


_span = T.StructType().add("token", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())


@F.pandas_udf(T.ArrayType(_span))
def _tokens(s):  # noqa: ANN001, ANN202
    def one(text: str) -> list[dict]:
        normal = script.normalize(text or "")
        spans = [normal.origin(t.start, t.end) for t in script.tokenize(normal.text)]
        return [{"token": text[a:b], "start": a, "end": b} for a, b in spans]

    return s.map(one)


def bio_tags(text: Column | str = "text", entities: Column | str = "entities") -> Column:
    """Tokens of the original text with the tag of the first entity around each."""
    entities = F.col(entities) if isinstance(entities, str) else entities

    def tag(t: Column) -> Column:
        e = F.try_element_at(F.filter(entities, lambda e: (e["start"] <= t["start"]) & (t["end"] <= e["end"])), F.lit(1))
        name = F.when(e.isNull(), "O").otherwise(F.concat(F.when(e["start"] == t["start"], "B-").otherwise("I-"), e["label"]))
        return F.struct(t["token"].alias("token"), name.alias("tag"))

    return F.transform(_tokens(text), tag)


def conll(docs: DataFrame) -> DataFrame:
    """value: ``token<TAB>tag`` lines and an empty line per document."""
    lines = F.transform(F.col("tags"), lambda t: F.concat(t["token"], F.lit("\t"), t["tag"], F.lit("\n")))
    return docs.withColumn("tags", bio_tags()).select(F.array_join(lines, "").alias("value"))


def tasks(docs: DataFrame, model: str = "padaflow") -> DataFrame:
    """value: one annotation task with predictions per document."""

    def result(e: Column) -> Column:
        value = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), F.array(e["label"]).alias("labels"))
        meta = F.struct(e["entity_id"].alias("entity_id"), e["canonical"].alias("canonical"))
        return F.struct(F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), value.alias("value"), e["confidence"].alias("score"), meta.alias("meta"))

    predictions = F.array(F.struct(F.lit(model).alias("model_version"), F.transform("entities", result).alias("result")))
    return docs.select(F.to_json(F.struct(F.struct("text").alias("data"), predictions.alias("predictions"))).alias("value"))


def as_array(values: DataFrame) -> DataFrame:
    """The JSON values of ``values(value)`` as the lines of one array.  All go through one task: for tools that want one file."""

    def run(batches):  # noqa: ANN001, ANN202
        begun = False
        for batch in batches:
            lines = [("," if begun or i else "[") + v for i, v in enumerate(batch.column(0).to_pylist())]
            begun = begun or bool(lines)
            yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
        yield pa.record_batch([pa.array(["]" if begun else "[]"])], names=["value"])

    return values.coalesce(1).mapInArrow(run, "value string")


def write(docs: DataFrame, path: str, fmt: str | None = None, one_array: bool = False) -> None:
    """Write a folder of text files; the format is given or the extension of the path.

    Tasks are written one per line, so that files of any size are written in parallel; with ``one_array`` as one
    file that holds one array.
    """
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format: {fmt!r}")
    out = {"jsonl": json_lines, "conll": conll, "tasks": tasks}[FORMATS[fmt]](docs)
    (as_array(out) if one_array and FORMATS[fmt] == "tasks" else out).write.text(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Files with a header line; with ``bom`` each begins with a byte order mark, for spreadsheets."""
    own = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
    own.write.csv(path, header=True)
