"""Versions of something stored: each is a small JSON file that names the parts it consists of.

Parts are written first, under names of their own, and never changed; the version's file appears at once, as it is renamed into place. A
reader holds to the version that it began with, and two writers can't both make the next one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_versions"


class Conflict(Exception):
    """Another writer made this version first; what was written for it is no part of any."""


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    system, folder = _path(spark, f"{path}/{FOLDER}")
    if not system.exists(folder):
        return []
    names = [x.getPath().getName() for x in system.listStatus(folder)]
    return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())


def load(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version, or the latest, consists of; None if there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    system, where = _path(spark, f"{path}/{FOLDER}/{known[-1] if version is None else version:010d}.json")
    stream = system.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, content: dict, version: int) -> dict:
    """Make ``content`` the version of that number, which must be the latest's next."""
    if version != (versions(spark, path) or [0])[-1] + 1:
        raise Conflict(f"{path}: version {version} is there already, or its forerunner isn't")
    content = content | {"version": version}
    system, made = _path(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    stream = system.create(made, True)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if not rename(spark, made.toString(), f"{path}/{FOLDER}/{version:010d}.json"):
        raise Conflict(f"{path}: version {version} is there already")
    return content


def rename(spark: SparkSession, made: str, final: str) -> bool:
    """Move a file or folder to a path that must be free; if it isn't, what was made is deleted."""
    system, source = _path(spark, made)
    target = _path(spark, final)[1]
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Exception:
        system.delete(source, True)
        if system.exists(target):
            return False
        raise


def part(kind: str) -> str:
    """A new part's name."""
    return f"{kind}-{uuid.uuid4().hex}"


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the versions before the latest ``keep`` and the parts that no version left has; returns these. Readers of the versions that go,
    and writers at work, must have ended."""
    known = versions(spark, path)
    kept = known[-keep:]
    used = json.dumps([load(spark, path, v) for v in kept])
    for v in known[:-keep]:
        system, where = _path(spark, f"{path}/{FOLDER}/{v:010d}.json")
        system.delete(where, False)
    system, top = _path(spark, path)
    gone = [x.getPath() for x in system.listStatus(top) if x.isDirectory() and x.getPath().getName() != FOLDER and x.getPath().getName() not in used]
    for x in gone:
        system.delete(x, True)
    return sorted(x.getName() for x in gone)
