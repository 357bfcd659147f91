"""What the operators share: scratch tables, size-checked joins and Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most rows and bytes a join sends to every executor; a larger side is shuffled instead.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


class Scratch:
    """Tables written to the folder that driver and executors share.

    A written table cuts the lineage: a lost executor costs a re-read, not the work before it.
    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local session
    (as in tests) gets a temporary folder and any other session a folder in its warehouse.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = root or "file://" + tempfile.mkdtemp(prefix="padaflow-")
        root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Delete all tables."""
        self.drop("")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in a hash table; null counts as little."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, T.ArrayType):
        each = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return F.size(value) * each
    return F.lit(8 * len(kind.fields) + 16 if isinstance(kind, T.StructType) else 8)


def side_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Join a side of unknown size: broadcast it if it has at most ``rows`` rows and ``size`` bytes, else shuffle.

    ``small`` should be a written table, as its rows and bytes are counted first.
    """
    width = F.lit(32)
    for f in small.schema.fields:
        width = width + F.coalesce(_width(F.col(f"`{f.name}`"), f.dataType), F.lit(8))
    n, total = small.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    few = n <= rows and (total or 0) <= size
    return big.join(F.broadcast(small) if few else small, on, how)


#: A key is hot if it holds this share of all rows, so there are at most HOT hot keys.
HOT = 1000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``big`` with one row of ``small`` for each key; ``weight`` is the key's rows in ``big``, ``total`` their sum.

    Keys with at least a thousandth of all rows, so a thousand keys at most, are broadcast; the rest is
    shuffled, where no key is larger than that.  Keys aren't null.  Both sides should be written tables.
    """
    hot, cold = small.where(F.col(weight) * HOT >= total), small.where(F.col(weight) * HOT < total)
    left = big.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return big.join(F.broadcast(hot), on).unionByName(left.join(cold, on))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def grouped(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a run of documents into ranges of at most ``most`` bytes (or one larger document)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


@lru_cache
def keep_memory() -> None:
    """Let glibc keep freed memory of up to 256 MB: else every large temporary array of numpy is mapped and zeroed anew, which takes longer than the arithmetic on it."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
