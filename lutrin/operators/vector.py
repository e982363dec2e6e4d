"""Exact nearest neighbours by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sizes import small

#: Numbers in the query vectors that go to all executors at once (16 MB); more are dealt with the rows, by a shuffle.
BROADCAST_NUMBERS = 2_000_000
#: Numbers in the rows that a task holds at once when queries are dealt to them.
PART_NUMBERS = 4_000_000
#: Distances are rounded to so many decimals before they are ranked.
DECIMALS = 6
#: Queries whose distances to all of a part are in memory together.
AT_ONCE = 64


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, F.isnull)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one size as the rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def nearest(own: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in asked, in own, distances) of what may be among each asked vector's nearest k, ties included.

    Products find them; their distances are then taken from the differences.
    """
    squares = np.square(own).sum(1)
    for at in range(0, len(asked), AT_ONCE):
        some = asked[at : at + AT_ONCE]
        far = squares[None, :] - 2 * (some @ own.T)
        most = np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(own) else far.max(1)
        slack = 10.0**-DECIMALS + 1e-9 * (squares.max() + np.square(some).sum(1))
        i, j = np.nonzero(far <= (most + slack)[:, None])
        yield i + at, j, np.square(own[j] - some[i]).sum(1)


def found_schema(queries: DataFrame, rows: DataFrame) -> StructType:
    return StructType([queries.schema["query_id"], rows.schema["chunk_id"]]).add("distance", "double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("distance", F.round("distance", DECIMALS)).withColumn("rank", rank).where(F.col("rank") <= k)


def few(asked: DataFrame) -> bool:
    """Whether the vectors of asked(vector, ...) are few enough to be sent to all executors. asked must be cheap to read."""
    sizes = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()
    return sizes.n <= BROADCAST_NUMBERS


def sent(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, distance) for rows(g, chunk_id, embedding) and few asked(g, query_id, vector), by a broadcast: each batch of rows gives
    what of it may be among the nearest k of the queries of the same g. A g's vectors are of one size."""
    table = asked.toArrow()
    groups: dict[int, tuple[pa.Array, np.ndarray]] = {}
    of = table.column("g").to_numpy()
    for g in np.unique(of).tolist() if len(of) else []:
        part = table.filter(pa.array(of == g))
        groups[g] = part.column("query_id").combine_chunks(), matrix(part.column("vector"), len(part.column("vector")[0]))
    known = rows.sparkSession.sparkContext.broadcast(groups)
    schema = found_schema(asked, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("g").to_numpy()
            for g in np.unique(of).tolist():
                if g not in known.value:
                    continue
                ids, vectors = known.value[g]
                part = batch.filter(pa.array(of == g))
                for i, j, far in nearest(matrix(part.column("embedding"), vectors.shape[1]), vectors, k):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), part.column("chunk_id").take(pa.array(j)), pa.array(far)], names=schema.fieldNames())

    return rows.select("g", "chunk_id", "embedding").mapInArrow(run, schema)


def dealt(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The same for any number of queries: a g's rows are dealt to parts that a task can hold, and each query goes to all parts of its g."""
    kind = rows.schema["embedding"].dataType
    if kind.simpleString() != "array<float>" or asked.schema["vector"].dataType != kind:
        rows, asked = rows.withColumn("embedding", F.col("embedding").cast("array<double>")), asked.withColumn("vector", F.col("vector").cast("array<double>"))
    parts = small(rows.groupBy("g").agg(F.ceil(F.sum(F.size("embedding")) / PART_NUMBERS).cast("int").alias("parts")))
    own = rows.join(parts, "g").select("g", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int").alias("part"), "chunk_id", F.col("embedding").alias("v"))
    each = asked.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", F.col("vector").alias("v"))
    both = own.withColumn("asks", F.lit(False)).unionByName(each.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    schema = found_schema(asked, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        vectors, asking = None, None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            place = np.stack([batch.column("g").to_numpy(), batch.column("part").to_numpy().astype(np.int64), asks.astype(np.int64)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, where = batch.slice(a, b - a), tuple(place[a][:2])
                if not asks[a]:
                    if where != asking:
                        held, asking = [], where
                    held.append(part)
                    vectors = None
                elif where == asking:
                    size = len(part.column("v")[0])
                    if vectors is None:
                        ids = pa.concat_arrays([x.column("chunk_id") for x in held])
                        vectors = np.concatenate([matrix(x.column("v"), size) for x in held])
                    for i, j, far in nearest(vectors, matrix(part.column("v"), size), k):
                        yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(i)), ids.take(pa.array(j)), pa.array(far)], names=schema.fieldNames())

    columns = both.select("g", "part", "asks", "chunk_id", "query_id", "v")
    return columns.repartition("g", "part").sortWithinPartitions("g", "part", "asks").mapInArrow(run, schema)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, distance, rank) for queries(query_id, vector) and corpus(chunk_id, embedding); ties by chunk_id.

    A stated set of queries against all rows. A query meets the rows whose vectors are of its length; null and empty vectors, and those with
    nulls, meet none. Few queries are broadcast and the rows stay where they are; more are dealt to parts of the rows.
    """
    rows = corpus.where(usable(F.col("embedding"))).select(F.size("embedding").cast("long").alias("g"), "chunk_id", "embedding")
    asked = queries.where(usable(F.col("vector"))).select(F.size("vector").cast("long").alias("g"), "query_id", "vector")
    return ranked((sent if few(asked) else dealt)(rows, asked, k), k)
