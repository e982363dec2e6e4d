"""A stored collection of rows that belong to sources: replaced, added to and read by versions.

Each addition is a segment of rows with the list of the sources that it speaks for; a row counts if no later segment speaks for
its source. So a source that is sent again replaces what it gave before, a source sent without rows is removed, and a reader never sees
half of a change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import small
from . import snapshots

GONE = "__gone"


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, or the latest; None if there is none. Of columns that aren't used nothing is fetched."""
    held = snapshots.load(spark, path, version)
    if held is None:
        return None
    segments = held["segments"]
    spoken = [spark.read.parquet(f"{path}/{s['sources']}").select("source") for s in segments]
    live = []
    for i, s in enumerate(segments):
        rows = spark.read.parquet(f"{path}/{s['rows']}")
        if i + 1 < len(segments):
            # Which of its sources others speak for is found among the lists of sources; those few, not the rows, are what is sent.
            later = reduce(DataFrame.union, spoken[i + 1 :]).withColumnRenamed("source", GONE)
            gone = later.join(spoken[i], F.col(GONE).eqNullSafe(F.col("source")), "left_semi").distinct()
            rows = rows.join(small(gone), rows[held["source"]].eqNullSafe(F.col(GONE)), "left_anti")
        live.append(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), live)


def _store(df: DataFrame, path: str, sources: DataFrame | None, source: str, apart: list[str]) -> dict:
    spark = df.sparkSession
    out = {"rows": snapshots.part("rows"), "sources": snapshots.part("sources")}
    df.write.partitionBy(*apart).parquet(f"{path}/{out['rows']}")
    own = spark.read.schema(df.schema).parquet(f"{path}/{out['rows']}").select(F.col(source).alias("source"))
    own = own if sources is None else own.union(sources.select(F.col(source).alias("source")))
    own.distinct().write.parquet(f"{path}/{out['sources']}")
    return out


def replace(df: DataFrame, path: str, source: str = "source", apart: tuple[str, ...] = ()) -> int:
    """Make df the whole collection; returns the version. Readers of earlier versions end with their own rows.

    apart: columns by which rows are stored apart, now and when others are added, so that those of one value are read alone.
    """
    spark = df.sparkSession
    held = snapshots.load(spark, path) or {"version": 0, "streams": {}}
    content = {"source": source, "apart": list(apart), "segments": [_store(df, path, None, source, list(apart))], "streams": held["streams"]}
    return snapshots.commit(spark, path, content, held["version"] + 1)["version"]


def upsert(df: DataFrame, path: str, sources: DataFrame | None = None, source: str = "source", stream: str | None = None, batch: int | None = None) -> int:
    """Add df's rows in place of what the collection has of their sources; returns the version that has them.

    sources: others (a column of that name) that are spoken for as well, so that what they had is removed. stream, batch: a micro-batch that the
    collection has already had from that stream (the same number or a later one) changes nothing, so that one that is sent again after a failure counts once.
    """
    spark = df.sparkSession
    held = snapshots.load(spark, path) or {"version": 0, "segments": [], "streams": {}, "source": source, "apart": []}
    had, at = held["streams"].get(stream, (-1, 0))
    if stream is not None and had >= batch:
        return at
    version = held["version"] + 1
    streams = held["streams"] | ({stream: (batch, version)} if stream is not None else {})
    content = held | {"segments": [*held["segments"], _store(df, path, sources, held["source"], held["apart"])], "streams": streams}
    return snapshots.commit(spark, path, content, version)["version"]


def added(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows that a version added, by the last of its segments."""
    return spark.read.parquet(f"{path}/{snapshots.load(spark, path, version)['segments'][-1]['rows']}")


def compact(spark: SparkSession, path: str) -> int:
    """Write the rows that count as one segment."""
    rows = read(spark, path)
    if rows is None:
        raise ValueError(f"{path} has no version")
    held = snapshots.load(spark, path)
    return replace(rows, path, held["source"], tuple(held["apart"]))
