"""Texts taken in as they arrive, each counted once: what a micro-batch makes is one version of a collection, and of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25
from ..sources import collection

FILES = "path string, modificationTime timestamp, length long, content binary"  # as the source of whole files has them
#: What opening a file counts for, in bytes, when a batch's files are dealt to tasks, and the tasks that look these files up once Spark has listed
#: the folder. By Spark's own figures (4 MB; a task a file, 10,000 at most) small files have about as many tasks as there are files.
OPEN_BYTES, LISTING_TASKS = 64 << 10, 200


def _session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings, views and functions, in which many small files make few tasks."""
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.openCostInBytes", OPEN_BYTES)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTING_TASKS)
    # What the driver holds of each file is all that grows there: what was found isn't kept for others, nor where its blocks lie, as a task has files from anywhere.
    own.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", 0)
    own.conf.set("spark.sql.sources.ignoreDataLocality", True)
    return own


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], source: str = "source_file", index: str | None = None, files: int | None = None) -> StreamingQuery:
    """Run ``step`` on (source, text) of each new .txt file of a folder; the rows, read by ``collection.read(spark, out)``, replace what a file of
    that name gave before, and a file without rows removes it. Ends when all is taken.

    step's rows have the file's name as ``source``. index: a folder where the rows' (chunk_id, document) are kept as a BM25 index as well. The collection
    and the index remember the batch that they had last, under the checkpoint's name: a batch that is run again because it failed
    before Spark noted its end, wherever that was, changes neither twice. files: how many a batch takes at most. The stream runs in a session
    of its own, a copy of the caller's.
    """
    reader = _session(spark).readStream.format("binaryFile").schema(FILES).option("latestFirst", False)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    texts = reader.load(path, pathGlobFilter="*.txt")
    rows = texts.select(F.col("_metadata.file_name").alias("source"), F.col("content").cast("string").alias("text"))  # Spark's reader of whole texts takes nearly twice the time for each file

    def take(df: DataFrame, batch: int) -> None:
        named = df.select(F.col("source").alias(source))
        version = collection.upsert(step(df), out, sources=named, source=source, stream=checkpoint, batch=batch)
        if index is not None:
            own = df.sparkSession
            before = collection.read(own, out, version - 1)
            gone = before.join(named.distinct(), source, "left_semi").select("chunk_id") if before is not None else None
            bm25.update(own, index, collection.added(own, out, version), gone, stream=checkpoint, batch=batch)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
