"""Packing by concatenate and cut.

Pass 1 tokenises, numbers the tokens within each partition and writes them.  Prefix sums over the
partitions' totals give every document its global offset.  Pass 2 cuts the line of all tokens into
fixed windows; each part of a document in a window is a boundary record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from padaflow.llm.bpe import bpe
from padaflow.llm.common import Scratch, side_join, small_batches

LENGTH, END = 2048, 1


def _tokenise(path: str, ranks: str, pattern: str, end: int):
    """Ids of each text, as ``tokenizers`` gives them, and their place in the partition.

    The rank file holds the same vocabulary, and its encoder gives the same ids several times as fast;
    texts that hold an added token's string go through ``tokenizers`` itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow, fast = Tokenizer.from_file(path), bpe(ranks, pattern)
        added = [t.content for t in slow.get_added_tokens_decoder().values()]
        before = 0
        for batch in batches:
            ids, at, size = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                own = slow.encode(text, add_special_tokens=False).ids if any(t in text for t in added) else fast.encode(text)
                own.append(end)
                ids.append(np.array(own, dtype="<u2").tobytes())
                at.append(before)
                size.append(len(own))
                before += len(own)
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(at, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "at", "size", "ids"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, size, crc, seq, off = [], [], [], [], [], []
            for i, (first, raw) in enumerate(zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                done = 0
                while done < len(ids):
                    place = first + done
                    n = min(len(ids) - done, length - place % length)
                    row.append(i)
                    start.append(done)
                    size.append(n)
                    crc.append(zlib.crc32(ids[done : done + n].tobytes()))
                    seq.append(place // length)
                    off.append(place % length)
                    done += n
            row = pa.array(row, pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id").take(row), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), batch.column("size").take(row), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, scratch: Scratch, path: str, ranks: str, pattern: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of ``length`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document is the ids
    of its text and then ``end``; null text counts as empty.  Every sequence but the last is full.
    Rows with a null or repeated doc_id are packed like others; other columns are ignored; an empty
    table gives no rows.  Ids must be below 65536.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.spark_partition_id().cast("bigint").alias("part"))
    ids = scratch.table(docs.mapInArrow(_tokenise(path, ranks, pattern, end), "doc_id bigint, part bigint, at bigint, size bigint, ids binary"), "ids")
    totals = ids.groupBy("part").agg(F.sum("size").alias("total"))
    # One row per partition of the input, whatever the number of documents.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = scratch.table(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "offsets")
    placed = side_join(ids, offsets, "part").select("doc_id", "size", (F.col("base") + F.col("at")).alias("first"), "ids")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(_cut(length), schema)
