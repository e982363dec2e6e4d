"""An inverted-file index of vectors: rows stored by the cell of their nearest center, of which a query reads the nearest few.

Centers come from k-means over a bounded sample, whose rounds are Spark jobs; every row is stored. What is found in the
cells is ranked by exact distances, so with all cells the rows are those of ``vector.search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources import io
from . import vector

#: Most cells (their centers are broadcast) and rows of the sample for each, and rounds of k-means.
CELLS, SAMPLE, ROUNDS = 4096, 64, 8
#: How many cells a query reads is measured when the index is built: so many that about ASKED rows, asked for their nearest DEPTH others, find this share.
ASKED, DEPTH, RECALL = 200, 10, 0.97
#: Numbers that a task makes of a batch at once (8 MB): distances to centers, and vectors of queries beside the cells that they read.
NUMBERS = 1_000_000
#: Cells that are asked for by name at most, so that files' statistics leave out the rest.
NAMED = 1000


@dataclass
class Index:
    """rows(cell, chunk_id, embedding), by cell, centers(cell, center, rows), and how many cells a query reads. Vectors of another length than
    the centers' are in a cell of their own, minus their length."""

    rows: DataFrame
    centers: DataFrame
    probes: int


def read(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()
    return Index(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centers"), about.probes)


def _cells(own: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    """The nearest k centers of each vector, of so many vectors at once that their distances are NUMBERS at most."""
    squares, out = np.square(centers).sum(1)[None, :], np.empty((len(own), min(k, len(centers))), np.int64)
    step = max(1, NUMBERS // len(centers))
    for at in range(0, len(own), step):
        far = squares - 2 * (own[at : at + step] @ centers.T)
        out[at : at + step] = far.argmin(1)[:, None] if k == 1 else np.argsort(far, axis=1, kind="stable")[:, :k]
    return out


def _probed(part: pa.RecordBatch, centers: np.ndarray, probes: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Queries (query_id, vector) beside each of the cells that they read, in pieces of NUMBERS numbers or of one query."""
    step = max(1, NUMBERS // (probes * centers.shape[1]))
    for at in range(0, part.num_rows, step):
        some = part.slice(at, step)
        cell = _cells(vector.matrix(some.column("vector"), centers.shape[1]), centers, probes)
        some = some.take(pa.array(np.repeat(np.arange(some.num_rows), probes)))
        yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), some.column("query_id"), some.column("vector")], names=names)


def _fit(sample: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """k-means over sample(v) from the first centers; a center that no row is nearest to stays."""
    context, centers = sample.sparkSession.sparkContext, first
    for _ in range(rounds):
        known = context.broadcast(centers)

        def sums(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            centers = known.value
            total, count = np.zeros_like(centers), np.zeros(len(centers), np.int64)
            for batch in batches:
                if batch.num_rows:
                    own = vector.matrix(batch.column("v"), centers.shape[1])
                    cell = _cells(own, centers)[:, 0]
                    np.add.at(total, cell, own)
                    count += np.bincount(cell, minlength=len(centers))
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.array(list(total[seen]), pa.list_(pa.float64()))], names=["cell", "n", "v"])

        def added(parts: pa.Table) -> pa.Table:
            total = vector.matrix(parts.column("v"), len(parts.column("v")[0])).sum(0)
            n = int(parts.column("n").to_numpy().sum())
            return pa.table({"cell": parts.column("cell").slice(0, 1), "n": pa.array([n]), "v": pa.array([total], pa.list_(pa.float64()))})

        made = sample.mapInArrow(sums, "cell long, n long, v array<double>").groupBy("cell").applyInArrow(added, "cell long, n long, v array<double>").toArrow()
        new = centers.copy()
        if made.num_rows:
            new[made.column("cell").to_numpy()] = vector.matrix(made.column("v"), centers.shape[1]) / made.column("n").to_numpy()[:, None]
        known.unpersist()
        if np.allclose(new, centers):
            break
        centers = new
    return centers


def _placed(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rows(chunk_id, embedding) with their cells."""
    known = rows.sparkSession.sparkContext.broadcast(centers)
    schema = StructType([StructField("cell", LongType()), rows.schema["chunk_id"], rows.schema["embedding"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = known.value
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            cell = -sizes.astype(np.int64)
            here = np.flatnonzero(sizes == centers.shape[1])
            if len(here):
                cell[here] = _cells(vector.matrix(batch.column("embedding").take(pa.array(here)), centers.shape[1]), centers)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("chunk_id"), batch.column("embedding")], names=schema.fieldNames())

    return rows.select("chunk_id", "embedding").mapInArrow(run, schema)


def build(corpus: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS, sample: int = SAMPLE, recall: float = RECALL) -> Index:
    """Write the index of corpus(chunk_id, embedding) at ``path`` and read it.

    cells: as many as the square root of the rows, CELLS at most, unless given. Centers are fitted on about ``sample`` rows for each cell, chosen by a
    hash of their ids, of the commonest length. recall: what the cells that a query reads by default are to find. Null and empty vectors, and those with nulls, are left out. Files are ranges of cells; a
    large cell is in several.
    """
    spark = corpus.sparkSession
    rows = corpus.where(vector.usable(F.col("embedding"))).select("chunk_id", "embedding")
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    n, length = (size["count"], size["size"]) if size else (0, 1)
    cells = max(1, min(cells or isqrt(n), CELLS, n))
    some = rows.where((F.size("embedding") == length) & (F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(max(1, n))) < sample * cells))
    kept = io.temporary(spark)
    some.select("chunk_id", F.col("embedding").alias("v")).write.mode("overwrite").parquet(kept)
    some = spark.read.parquet(kept)
    first = some.orderBy(F.xxhash64("chunk_id", F.lit(2)), "chunk_id").limit(cells).select("v").toArrow()
    centers = vector.matrix(first.column("v"), length) if first.num_rows else np.zeros((1, length))
    centers = _fit(some.select("v"), centers, rounds if first.num_rows else 0)
    placed = _placed(rows, centers)
    placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("rows"))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centers)], "cell long, center array<double>")
    table.join(stored, "cell", "left").select("cell", "center", F.coalesce("rows", F.lit(0)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    probes = _probes(spark.read.parquet(f"{path}/rows").where("cell >= 0"), centers, n, recall)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return read(spark, path)


def _probes(rows: DataFrame, centers: np.ndarray, n: int, recall: float) -> int:
    """In how many of the cells nearest to a row this share of its nearest others is, by an exact search for some rows."""
    asked = rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(max(1, n))) < ASKED).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = vector.search(rows, asked, DEPTH + 1).where("query_id <> chunk_id").select("query_id", "chunk_id")
    found = rows.select("chunk_id", "cell").join(F.broadcast(exact), "chunk_id").select("query_id", "cell").toArrow()
    table = asked.toArrow()
    if not found.num_rows:
        return len(centers)
    nearest = _cells(vector.matrix(table.column("vector"), centers.shape[1]), centers, len(centers))
    place = {q: np.argsort(row) for q, row in zip(table.column("query_id").to_pylist(), nearest, strict=True)}
    needed = sorted(int(place[q][c]) + 1 for q, c in zip(found.column("query_id").to_pylist(), found.column("cell").to_pylist(), strict=True))
    return needed[min(len(needed) - 1, int(recall * len(needed)))]


def add(index_path: str, corpus: DataFrame) -> Index:
    """Store more rows in the cells of an index's centers, and read it. The centers stay; an id that is there already is there twice."""
    spark = corpus.sparkSession
    index = read(spark, index_path)
    rows = corpus.where(vector.usable(F.col("embedding"))).select("chunk_id", "embedding")
    placed = _placed(rows, _centers(index))
    placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.mode("append").parquet(f"{index_path}/rows")
    return read(spark, index_path)


def _centers(index: Index) -> np.ndarray:
    table = index.centers.select("cell", "center").toArrow().sort_by("cell")
    return vector.matrix(table.column("center"), len(table.column("center")[0]))


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, rank) for queries(query_id, vector), from the ``probes`` cells of nearest center (by default the index's); ties by
    chunk_id.

    A query of another length than the centers' reads all rows of its length; null and empty vectors, and those with nulls, find nothing. Few
    queries are broadcast and only rows of the cells that they ask for are read; more are dealt to the rows by cell.
    """
    centers = _centers(index)
    known = queries.sparkSession.sparkContext.broadcast(centers)
    probes = min(probes or index.probes, len(centers))
    schema = StructType([StructField("g", LongType()), queries.schema["query_id"], queries.schema["vector"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = known.value
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            here, other = np.flatnonzero(sizes == centers.shape[1]), np.flatnonzero(sizes != centers.shape[1])
            if len(here):
                yield from _probed(batch.take(pa.array(here)), centers, probes, schema.fieldNames())
            if len(other):
                part = batch.take(pa.array(other))
                yield pa.RecordBatch.from_arrays([pa.array(-sizes[other].astype(np.int64)), part.column("query_id"), part.column("vector")], names=schema.fieldNames())

    asked = queries.where(vector.usable(F.col("vector"))).select("query_id", "vector").mapInArrow(run, schema)
    rows = index.rows.withColumnRenamed("cell", "g")
    if not vector.few(asked):
        return vector.ranked(vector.dealt(rows, asked, k), k)
    cells = [r.g for r in asked.select("g").distinct().limit(NAMED + 1).collect()]
    return vector.ranked(vector.sent(rows.where(F.col("g").isin(cells)) if len(cells) <= NAMED else rows, asked, k), k)
