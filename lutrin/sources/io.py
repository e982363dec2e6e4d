"""Readers and writers. All paths are arguments and go through Spark."""

from __future__ import annotations

import hashlib
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collection, files, snapshots

BLOCKS = "source string, page_no int, page_width double, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
OCR_PAGES = "source string, page_no int, text string"
GAZETTE = "source_file string, total_documents int, documents array<struct<title string, articles array<string>, context string>>"
EXTRACTS = "source string, official_id string, text string, journal_date string, type string"
GOLDEN = "query_id long, query string, expected_doc_id string, expected_answer string"
#: Where recognition begins (the cover is left out), its resolution and its language.
FIRST_PAGE, DPI, LANGUAGE = 2, 300, "fra"


def _name() -> Column:
    return F.col("_metadata.file_name")


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _place(spark, path)
    return system.exists(where)


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in local mode one of the application's own, which goes with it,
    where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"file://{tempfile.gettempdir()}/lutrin-{spark.sparkContext.applicationId}"
    system, where = _place(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def temporary(spark: SparkSession) -> str:
    """A new folder among the shared ones that goes when the application ends."""
    path = f"{shared(spark)}/lutrin-{uuid.uuid4().hex}"
    system, where = _place(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, where = _place(spark, path)
    system.delete(where, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the names, lengths and times of the files at a path (a file, or a folder of files)."""
    system, where = _place(spark, path)
    files = sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in system.listStatus(where))
    return hashlib.sha256(repr(files).encode()).hexdigest()[:24]


def code(*modules: ModuleType) -> str:
    """Of the source of modules: what they store is of a format of its own."""
    return hashlib.sha256("".join(map(inspect.getsource, modules)).encode()).hexdigest()[:12]


def once(spark: SparkSession, path: str, write: Callable[[str], object]) -> str:
    """Have ``write`` make a folder at ``path`` unless it is there; it is made elsewhere and moved when whole."""
    system, where = _place(spark, path)
    if not system.exists(where):
        made = f"{path}-{uuid.uuid4().hex}"
        write(made)
        snapshots.rename(spark, made, path)  # unless another session was faster
    return path


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of the folder's PDF files, the extension in any case."""
    return spark.read.format("binaryFile").load(path).select(_name().alias("source"), "content").where(F.lower("source").endswith(".pdf"))


def read_pages(pdfs: DataFrame, reader: Callable[[bytes], list[tuple]], schema: str = BLOCKS) -> DataFrame:
    """Rows that a reader makes of each file's bytes (after its source), and ``error``: page blocks, or recognised pages.

    The reader is given by the caller, as PDF libraries aren't part of this package. A file that it can't read has one row of nulls
    but for its source and what went wrong; all other rows have no error. See ``pages`` and ``errors``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                try:
                    rows = [(source, *x, None) for x in reader(bytes(content))]
                except Exception as e:  # one file's fault
                    rows = [(source, *[None] * (len(names) - 1), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[*names, "error"], dtype=object)

    return pdfs.mapInPandas(run, f"{schema}, error string")


def recognise(pdfs: DataFrame, reader: Callable[..., list[tuple[int, str]]], first_page: int = FIRST_PAGE, dpi: int = DPI, language: str = LANGUAGE) -> DataFrame:
    """(source, page_no, text, error) of pages that a reader recognises; it is told where to begin, the resolution and the language."""
    return read_pages(pdfs, lambda content: [x for x in reader(content, first_page=first_page, dpi=dpi, language=language) if x[0] >= first_page], OCR_PAGES)


def pages(read: DataFrame) -> DataFrame:
    """The rows of files that could be read."""
    return read.where("error is null").drop("error")


def errors(read: DataFrame) -> DataFrame:
    """(source, error) of those that couldn't."""
    return read.where("error is not null").select("source", "error")


def read_texts(spark: SparkSession, path: str, any_case: bool = True) -> DataFrame:
    """(source, text) of the folder's .txt files, or of one file, a row per file; a path that isn't there gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "source string, text string")
    rows = spark.read.text(path, wholetext=True).select(_name().alias("source"), F.col("value").alias("text"))
    return rows.where(F.lower("source").endswith(".txt") if any_case else F.col("source").endswith(".txt"))


def read_gazette(spark: SparkSession, path: str) -> DataFrame:
    """Gazette JSON: whole files or lines; those without documents are skipped."""
    rows = spark.read.schema(GAZETTE).json(path, multiLine=True, pathGlobFilter="*.json")
    return rows.withColumn("source_file", F.coalesce("source_file", _name())).where("documents is not null")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions, JSON lines with query, expected_doc_id and, for answers, expected_answer; numbered by their hash where they
    have no query_id."""
    rows = spark.read.schema(GOLDEN).json(path)
    return rows.withColumn("query_id", F.coalesce("query_id", F.xxhash64("query"))).where("query is not null")


def text_name(source: Column) -> Column:
    return F.regexp_replace(source, r"(?i)\.pdf$", ".txt")


def json_name(source: Column) -> Column:
    return F.concat(F.regexp_replace(source, r"\.[^.]*$", ""), F.lit(".json"))


def write_texts(texts: DataFrame, path: str, named: bool = False) -> None:
    """(source, text), replacing what is there: Parquet, or with ``named`` a file for each source, .txt in place of .pdf."""
    if named:
        files.write_named(texts.select(text_name(F.col("source")).alias("name"), F.col("text").alias("content")), path)
    else:
        texts.select("source", "text").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, name: str | None = None) -> None:
    """JSON lines, replacing what is there; with ``name``, a column, an indented file for each row, .json in place of the name's last suffix."""
    if name:
        content = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
        files.write_named(df.select(json_name(F.col(name)).alias("name"), content.alias("content")), path)
    else:
        df.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The collection, replaced as a whole: a new version, which readers of the one before don't see. Parents and children are stored apart, so
    that either is read alone."""
    collection.replace(chunks, path, apart=("type",))


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The collection's latest version, or None if there is none. Columns that aren't used, embeddings among them, aren't fetched."""
    return collection.read(spark, path)
