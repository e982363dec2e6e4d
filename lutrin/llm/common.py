"""What the operators of this subpackage share: scratch tables, size-checked broadcasts, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: Rows of two or three longs up to this number (some 6 MB) are broadcast; beyond it the same join is a shuffle.
BROADCAST_ROWS = 250_000
#: Text that a Python worker turns into words at a time.
CHUNK_BYTES = 2_000_000


#: Rows of whole texts, and bytes, that pass between the JVM and Python at a time.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches than the 10,000 rows and 64 MB by default, for memory's sake: rows are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default
        spark.conf.set(name, str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; what is written there goes when the application ends.

    Where the setting is unset, a temporary folder is taken in local mode (tests); on a cluster that would be each node's own, so it
    is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lutrin-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lutrin-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system and the path object of a folder, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. The files go when the application ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    system, where = _folder(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Settled tables that an operator needs only until its own result is settled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            system, where = _folder(self.spark, path)
            system.delete(where, True)
        self.paths.clear()


def release(sent: Broadcast) -> None:
    """Let go of a broadcast value that a worker has read, where several are used in turn; it is read again from the worker's disk."""
    sent.__dict__.pop("_value", None)


def others(df: DataFrame, made: Iterable[str]) -> list[StructField]:
    """df's fields without those that have a name of ``made``, in any case, as Spark's names are."""
    names = {x.lower() for x in made}
    return [f for f in df.schema.fields if f.name.lower() not in names]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many (narrow) rows. df must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 of each value, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) of parts of a batch with about so many bytes of text, a row at least."""
    column = batch.column(name)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    begin, total, texts = 0, 0, []
    for i in range(len(column)):
        x = column[i].as_py() or b""
        if texts and total + len(x) > most:
            yield begin, i, texts
            begin, total, texts = i, 0, []
        texts.append(x)
        total += len(x)
    if texts:
        yield begin, len(column), texts


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    names = {x.lower() for x in df.columns}
    return next(x for i in range(len(names) + 1) if (x := f"__{stem}{i or ''}").lower() not in names)


#: Code points below this are split by a class that is written out; text with others goes through the library's own splitter.
PLAIN = 0x250


def letters_digits() -> tuple[str, str]:
    """Character classes (without brackets) of the letters and the numbers below PLAIN."""
    kind = [unicodedata.category(chr(i))[0] for i in range(PLAIN)]
    return tuple("".join(f"\\u{i:04x}" for i in range(PLAIN) if kind[i] == k) for k in "LN")  # type: ignore[return-value]


NOT_PLAIN = re.compile(r"[^\x00-įı-ɏ]")
