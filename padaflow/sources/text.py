"""Document and gold sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, blank lines kept: file, line (from 1 in each file), text.

    A file is read by one task, so that lines can be numbered in it.
    """
    files = spark.read.text(path, wholetext=True, lineSep=None).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)
    return files.select("file", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as a stream: text."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (line from 0), lang, text, entities: ``{"text", "entities": [[surface, label]], "lang"}`` per line."""
    rows = read_lines(spark, path).where("trim(text) != ''")
    j = F.from_json("text", "lang string, text string, entities array<array<string>>")
    return rows.select((F.col("line") - 1).cast("bigint").alias("doc_id"), j.alias("j")).select("doc_id", F.coalesce("j.lang", F.lit("?")).alias("lang"), "j.text", "j.entities")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, text: whole text files; bytes that aren't UTF-8 become U+FFFD.  PDF files need pypdf, which is optional."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return raw.select("file", F.when(F.lower("file").endswith(".pdf"), _pdf("content")).otherwise(_lenient("content")).alias("text"))


@F.pandas_udf(T.StringType())
def _lenient(s):  # noqa: ANN001, ANN202
    return s.map(lambda b: bytes(b).decode("utf-8", "replace"))


def _pdf(column: str):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def pages(s):  # noqa: ANN001, ANN202
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ImportError("reading PDF files needs pypdf") from e
        return s.map(lambda b: "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(bytes(b))).pages))

    return pages(column)
