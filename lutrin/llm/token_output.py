"""Token ids as Parquet list columns.

Files are ranges of ascending document ids. Ids are int32 lists: dictionary-encoded where a row group has few enough different
ones, else delta-encoded (format version 2). Row groups and pages have set sizes, and the writer adds column indexes, so that a reader of some
documents, or of the counts alone, fetches only those pages. Each row has where its ids start among its file's; ``index`` has a
row per file, with where the file's ids start among all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import NOT_PLAIN, chunks, letters_digits, others, small

KEPT_WORDS = 300_000
ROW_GROUP_BYTES, PAGE_BYTES = 16 << 20, 256 << 10
#: Stored input (or text, where the plan doesn't know its size) of a file of ids, and the first characters by which rows of one doc_id
#: are dealt to files.
FILE_BYTES, DEALT_CHARACTERS = 16 << 20, 64
#: What plans of unknown size say is above this.
UNKNOWN_BYTES = 1 << 55
SCHEMA = StructType([StructField("shard", T.IntegerType()), StructField("doc_id", T.LongType()), StructField("shard_start", T.LongType()), StructField("n_tokens", T.LongType()), StructField("ids", T.ArrayType(T.IntegerType(), False))])


class WordTokenizer:
    """Ids by the tokenizers library for a vocabulary whose pieces are words (an end-of-word suffix, white space dropped).

    Plain text is cut into the vocabulary's pieces here, and the library encodes each new piece once; any other text, with
    special tokens or rarer characters, goes to the library as a whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        letter, digit = letters_digits()
        self.split = re.compile(rf"[{letter}]+|[{digit}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{letter}{digit}]+")
        self.split_ascii = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9]+")
        ends = {i for x, i in self.library.get_vocab(with_added_tokens=False).items() if x.endswith("</w>")}
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[list(ends)] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, get = self.known, self.known.get
        cut: list[tuple[list[str], list[bytes | None], list[int]] | None] = []
        new: set[str] = set()
        for x in texts:
            ascii, low = x.isascii(), x.lower()
            if "<|" in x or (not ascii and ("İ" in x or NOT_PLAIN.search(x) or NOT_PLAIN.search(low))):  # some capitals' small letters lie beyond
                cut.append(None)
                continue
            pieces = (self.split_ascii if ascii else self.split).findall(low)
            codes = list(map(get, pieces))
            missing, i = [], -1
            for _ in range(codes.count(None)):
                i = codes.index(None, i + 1)
                missing.append(i)
            new.update([pieces[i] for i in missing])
            cut.append((pieces, codes, missing))
        fresh = dict(zip(order := list(new), self._words(order), strict=True))
        for w, ids in fresh.items():
            if len(known) >= KEPT_WORDS:
                break
            if len(w) < 64:
                known[w] = ids
        out = []
        for x, got in zip(texts, cut, strict=True):
            if got is None:
                out.append(np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            pieces, codes, missing = got
            for i in missing:
                codes[i] = fresh[pieces[i]]
            out.append(b"".join(codes))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch(words, add_special_tokens=False)]
        flat = ids.tobytes()
        ends = (cuts * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def tokenizer_of(spec: str) -> WordTokenizer:
    """A worker's tokenizer, with the words that it knows from task to task."""
    return WordTokenizer(spec)


def write_tokens(df: DataFrame, vocabulary: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, files: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of each text, with ``end_id`` appended, at ``path`` in ascending order of doc_id (``tokens``, ``index``).

    vocabulary: a file of the tokenizers library, sent from the driver. Null and empty texts have the end id only. Null doc_ids
    come first; rows of one doc_id are ordered by their first DEALT_CHARACTERS, and within a file by text. Repeated rows are all written. An empty table gives empty files. Other columns
    aren't written. files: by default one for each file_bytes of input (16 MB; some 256 MB are better where the input has many terabytes). Rows of one doc_id, or equal ones, may lie in several files.
    """
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    if files is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= UNKNOWN_BYTES:
            size = own.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
        files = max(1, -(-size // file_bytes))
    # The last key parts rows that are alike in the others; in which order they come makes no difference.
    dealt = own.withColumn("first", F.substring("t", 1, DEALT_CHARACTERS)).withColumn("row", F.monotonically_increasing_id())
    placed = dealt.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "first", "row").drop("first", "row")
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t").select(F.spark_partition_id().alias("shard"), "doc_id", "t")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, start = tokenizer_of(spec.value), 0
        for batch in batches:
            for a, b, texts in chunks(batch, "t"):
                codes = [x + end for x in tokenizer.encode([x.decode() for x in texts])]
                n = np.array([len(x) // 4 for x in codes], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(codes), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(start + ends - n), pa.array(n), ids], names=SCHEMA.fieldNames())
                start += int(ends[-1]) if len(ends) else 0

    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "compression": "zstd"}
    placed.mapInArrow(run, SCHEMA).write.options(**options).parquet(f"{path}/tokens")
    total = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    # One row for each file, so one task's window is bounded by their number.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total.withColumn("before", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of what write_tokens wrote. Unused columns aren't fetched.

    Null doc_ids, repeated rows and documents of the end id alone are as they were written; empty files give no rows.
    """
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    index = spark.read.schema("shard int, shard_tokens long, before long").parquet(f"{path}/index").select("shard", "before")
    return tokens.join(small(index), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def checksums(df: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """df with the unsigned CRC-32 of a list of ids as little-endian unsigned 32-bit integers, in place of the list.

    Null and empty lists have that of no bytes, 0. A column of df named as the new one, in any case, is replaced; others stay; rows are
    independent, and an empty table gives an empty table.
    """
    kept = others(df, (ids, name))
    schema = StructType([*kept, StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False))
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sums, pa.int64())], names=schema.fieldNames())

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{ids}`")).mapInArrow(run, schema)
