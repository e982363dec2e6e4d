"""Single files by name, read and written by tasks: a sink of one file a row, and a source of the pages of files.

Tasks reach the folder through pyarrow's file systems, so a path is a local one that all share, or hdfs, s3 or gs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


# One file a row


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where it was written, its name)


class NamedFiles(DataSource):
    """A sink of rows (name, content): files of these names in a folder. Options: path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], schema, overwrite)


class NamedFilesWriter(DataSourceWriter):
    """Files are written to a hidden folder, and get their names once all tasks have ended; if one fails none does. A task that is still at work
    when the others are given up may leave something in the hidden folder."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.at = [schema.fieldNames().index(x) for x in ("name", "content")]
        self.made = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, made = place(self.made)
        folder, files = f"{made}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        for row in iterator:
            name, content = (row[i] for i in self.at)
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not a file's name: {name!r}")
            with system.open_output_stream(f"{folder}/{len(files)}") as out:
                out.write((content or "").encode())
            files.append((f"{folder}/{len(files)}", name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = place(self.path)
        files = [x for m in messages if m for x in m.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("several rows have one name")
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path)):
                if x.type == fs.FileType.File and x.base_name not in names:
                    system.delete_file(x.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: system.move(x[0], f"{path}/{x[1]}"), files))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, made = place(self.made)
        if system.get_file_info(made).type == fs.FileType.Directory:
            system.delete_dir(made)


def write_named(df: DataFrame, path: str) -> None:
    """A file for each row of df(name, content), UTF-8, exactly the content (null is empty), in place of all files of the folder.

    Names must be different and have no slash. They and the files' places are what the driver holds.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("name", "content").write.format("named_files").mode("overwrite").option("path", path).save()


# Pages of files


class PageReader(Protocol):
    """What knows a format: how many pages a file's bytes have, and the rows of one of them (without source and page_no)."""

    def count(self, content: bytes) -> int: ...

    def rows(self, content: bytes, page: int) -> list[tuple]: ...


@dataclass
class Pages(InputPartition):
    files: list[tuple[str, int, int | None]]  # (path, first page, the page after the last or None)


class PagesReader(DataSourceReader):
    #: Bytes of files that a task reads; a larger file is read by several, each with a range of its pages.
    TASK_BYTES = 16 << 20

    def __init__(self, path: str, suffix: str, first: int, read: PageReader, width: int):
        self.path, self.suffix, self.read_pages, self.width = path, suffix.lower(), read, width
        self.low, self.high, self.only, self.asked = first, None, None, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            page = getattr(f, "attribute", None) == ("page_no",)
            if page and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high if self.high is not None else f.value + 1, f.value + 1)
            elif page and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif page and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            elif page and isinstance(f, In):
                self.only = set(f.value) & (self.only if self.only is not None else set(f.value))
            else:
                yield f
                continue
            self.asked = True  # a row without a page, as of a file that can't be read, passes no such filter

    def partitions(self) -> list[Pages]:
        system, path = place(self.path)
        found = sorted((x.path, x.size) for x in system.get_file_info(fs.FileSelector(path, recursive=False)) if x.type == fs.FileType.File and x.base_name.lower().endswith(self.suffix))
        out, held, size = [], [], 0
        for name, bytes_ in found:
            if bytes_ > self.TASK_BYTES:
                out += self._ranges(system, name, bytes_)
                continue
            if held and size + bytes_ > self.TASK_BYTES:
                out.append(Pages(held))
                held, size = [], 0
            held.append((name, 0, None))
            size += bytes_
        return [*out, *([Pages(held)] if held else [])] or [Pages([])]

    def _ranges(self, system: fs.FileSystem, name: str, size: int) -> list[Pages]:
        try:
            with system.open_input_stream(name) as stream:
                count = self.read_pages.count(stream.read())
        except Exception:  # the task that reads it says what is wrong
            return [Pages([(name, 0, None)])]
        parts = min(max(1, count), -(-size // self.TASK_BYTES))
        ends = [count * i // parts for i in range(parts + 1)]
        return [Pages([(name, a, b)]) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        system, _ = place(self.path)
        for name, first, end in partition.files:
            source = name.rsplit("/", 1)[-1]
            try:
                with system.open_input_stream(name) as stream:
                    content = stream.read()
                rows = []
                last = self.read_pages.count(content) if end is None else end
                for page in range(max(first, self.low), last if self.high is None else min(last, self.high)):
                    if self.only is None or page in self.only:
                        rows += [(source, page, *x, None) for x in self.read_pages.rows(content, page)]
            except Exception as e:  # one file's fault
                rows = [] if self.asked else [(source, None, *[None] * self.width, f"{type(e).__name__}: {e}")]
            yield from rows


def page_source(name: str, columns: str, reader: PageReader, suffix: str = ".pdf", first: int = 0) -> type[DataSource]:
    """A source for ``spark.read.format(name).load(folder)``: (source, page_no, columns, error) of the pages of all files with the suffix, in any case.

    reader knows the format, and is given by the caller. Tasks have about PagesReader.TASK_BYTES of files; files that are larger are split by pages.
    Filters on page_no reach the reader, so that other pages aren't made. Pages are numbered from 0; those before ``first`` are left out. A file that
    can't be read is one row of nulls but for source and error, unless pages are asked for.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"source string, page_no int, {columns}, error string"

        def reader(self, schema: StructType) -> PagesReader:
            return PagesReader(self.options["path"], suffix, first, reader, len(schema) - 3)

    return Source


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a source known, and let filters through to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
