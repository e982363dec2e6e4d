"""Substring search by an index of character trigrams: only texts that have all of a pattern's trigrams are read and searched.

The index has the texts by id, so that few of them can be asked for by name, and the trigrams' postings in blocks, each of one trigram in
one range of rows, stored by trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .sizes import small

#: Rows of a range at most, and characters that end one.
RANGE_ROWS, RANGE_CHARACTERS = 1024, 4_000_000
#: Trigrams of a pattern that are looked up, those that fewest rows have, and ids that are asked for by name at most.
GRAMS, NAMED = 4, 1000


@dataclass
class Index:
    """texts(chunk_id, document), by chunk_id; blocks(gram, n, ids), by gram; grams(gram, df)."""

    texts: DataFrame
    blocks: DataFrame
    grams: DataFrame


def grams(text: str) -> np.ndarray:
    """The different trigrams of a text, three code points of 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def read(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("texts", "blocks", "grams")))


def build(corpus: DataFrame, path: str) -> Index:
    """Write the index of corpus(chunk_id, document) at ``path`` and read it. Null texts are in it and match nothing."""
    spark, kind = corpus.sparkSession, corpus.schema["chunk_id"].dataType
    rows = corpus.select("chunk_id", "document")
    rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{path}/texts")
    schema = StructType().add("gram", LongType()).add("n", LongType()).add("ids", ArrayType(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list = []
        size = 0

        def block() -> pa.RecordBatch:
            gram, row = np.concatenate(held), np.repeat(np.arange(len(held)), list(map(len, held)))
            order = np.argsort(gram, kind="stable")
            gram, row = gram[order], row[order]
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
            offsets = pa.array(np.append(starts, len(gram)), pa.int32())
            own = pa.concat_arrays(ids).take(pa.array(row))
            return pa.RecordBatch.from_arrays([pa.array(gram[starts]), pa.array(np.diff(np.append(starts, len(gram)))), pa.ListArray.from_arrays(offsets, own)], names=schema.fieldNames())

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("document")[i].as_py() or ""
                held.append(grams(text))
                ids.append(batch.column("chunk_id").slice(i, 1))
                size += len(text)
                if len(held) == RANGE_ROWS or size >= RANGE_CHARACTERS:
                    yield block()
                    held, ids, size = [], [], 0
        if held:
            yield block()

    # Read back by the order of ids, so that a range's rows are neighbours.
    stored = spark.read.schema(rows.schema).parquet(f"{path}/texts")
    stored.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/made")
    made = spark.read.schema(schema).parquet(f"{path}/made")
    made.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/blocks")
    made.groupBy("gram").agg(F.sum("n").alias("df")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/made")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return read(spark, path)


def candidates(index: Index, pattern: str) -> DataFrame | None:
    """(chunk_id) of the texts that have the pattern's rarest trigrams; None if the pattern is too short to have one."""
    asked = grams(pattern).tolist()
    if not asked:
        return None
    known = index.grams.where(F.col("gram").isin(asked)).collect()
    if len(known) < len(asked):  # some trigram is in no text
        return index.texts.select("chunk_id").limit(0)
    rarest = [r.gram for r in sorted(known, key=lambda r: (r.df, r.gram))[:GRAMS]]
    rows = index.blocks.where(F.col("gram").isin(rarest)).select("gram", F.explode("ids").alias("chunk_id"))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") >= len(rarest)).select("chunk_id")


def search(index: Index, pattern: str) -> DataFrame:
    """(chunk_id, document) of the texts with the pattern in them, as it is written. Repeated ids are one another's candidates, and each is searched."""
    found = candidates(index, pattern)
    texts = index.texts
    if found is not None:
        some = [r.chunk_id for r in found.limit(NAMED + 1).collect()]
        texts = texts.where(F.col("chunk_id").isin(some)) if len(some) <= NAMED else texts.join(small(found), "chunk_id", "left_semi")
    return texts.where(F.col("document").contains(pattern))
