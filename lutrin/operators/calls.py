"""Answers of a model that are remembered: each prompt is asked once, whoever asks and however often a task is run.

Answers lie in a collection by the hash of model and prompt. While a job asks, each answer is also noted at once in a file of its own, so
that a task which is run again, or a job that is, finds what was answered before; only what was under way when it ended is asked twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import collection, files, io
from .providers import Generate, answered
from .sizes import small

#: Prompts that a model is given at once, and how often a prompt is tried in all.
BATCH, TRIES = 16, 2


def key(model: str, prompt: str) -> F.Column:
    return F.sha2(F.concat(F.lit(f"{model}\x00"), F.col(prompt)), 256)


def ask(prompts: DataFrame, path: str, model: str, make: Callable[[], Generate], prompt: str = "prompt", batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """prompts with ``answer`` and ``error``: of a prompt that was answered the first, of one that failed ``tries`` times the second, of null neither.

    path: the folder of the answers, which tasks must reach as well. model: its name, with all that an answer depends on. A prompt that failed
    fewer times, in this job or others, is asked again.
    """
    spark = prompts.sparkSession
    keyed = prompts.where(F.col(prompt).isNotNull()).select(key(model, prompt).alias("source"), F.col(prompt).alias("prompt"))
    one = keyed.groupBy("source").agg(F.first("prompt").alias("prompt"))
    known = collection.read(spark, path)
    if known is not None:
        settled = known.where(F.col("error").isNull() | (F.col("tries") >= tries)).select("source")
        spent = known.select("source", "tries")
        one = one.join(settled, "source", "left_anti").join(spent, "source", "left").select("source", "prompt", F.coalesce("tries", F.lit(0)).alias("tries"))
    else:
        one = one.withColumn("tries", F.lit(0))
    missing = io.temporary(spark)
    one.write.mode("overwrite").parquet(missing)
    notes = f"{path}/_calls"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = files.place(notes)
        system.create_dir(folder, recursive=True)
        asked = None
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                names, texts, spent = (part.column(x).to_pylist() for x in ("source", "prompt", "tries"))
                noted = {x.base_name for x in system.get_file_info([f"{folder}/{n}" for n in names]) if x.type == fs.FileType.File}
                new = [i for i, n in enumerate(names) if n not in noted]
                asked = asked or (make() if new else None)
                for i, (answer, error, used) in zip(new, answered(asked, [texts[i] for i in new], [tries - spent[i] for i in new]) if new else [], strict=True):
                    with system.open_output_stream(f"{folder}/{names[i]}.{id(part)}") as out:
                        out.write(json.dumps([answer, error, spent[i] + used]).encode())
                    system.move(f"{folder}/{names[i]}.{id(part)}", f"{folder}/{names[i]}")
                out = []
                for n in names:
                    with system.open_input_stream(f"{folder}/{n}") as stream:
                        out.append(json.loads(stream.read()))
                columns = [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("source"), *columns], names=["source", "answer", "error", "tries"])

    made = spark.read.schema(one.schema).parquet(missing)
    if made.limit(1).count():
        collection.upsert(made.mapInArrow(run, "source string, answer string, error string, tries int"), path)
        system, folder = files.place(notes)
        system.delete_dir(folder)
    answers = collection.read(spark, path)
    if answers is None:
        return prompts.select("*", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))
    name = "__call"
    answers = small(answers.select(F.col("source").alias(name), "answer", "error"))
    return prompts.withColumn(name, key(model, prompt)).join(answers, name, "left").drop(name)
