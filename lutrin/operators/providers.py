"""Models behind one interface: each worker makes its model once and is given Arrow batches of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]


def stub_embedder(size: int = 64) -> Embed:
    """Deterministic unit vectors from hashes, for tests and where no model is there."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for x in texts:
            raw = b"".join(hashlib.sha256(f"{i}|{x}".encode()).digest() for i in range(-(-size // 32)))[:size]
            v = [b - 127.5 for b in raw]
            n = sum(a * a for a in v) ** 0.5
            out.append([a / n for a in v])
        return out

    return embed


def stub_generator() -> Generate:
    return lambda prompts: [f"SCORE: {len(p) % 11}" for p in prompts]


def stub_segmenter() -> Generate:
    """Answers to a segmentation prompt with one tagged text: the prompt's end, after its own example."""

    def one(prompt: str) -> str:
        text = prompt[prompt.index("[[END]]\n\n") + 9 :].removesuffix("\n")
        return f"Voici :\n[[START]]\nID: Décret de {len(text)} signes\nCONTENT: {text}\n[[END]]"

    return lambda prompts: list(map(one, prompts))


def embed(df: DataFrame, make: Callable[[], Embed] = stub_embedder, text: str = "document") -> DataFrame:
    """df with ``embedding`` (array of float); null text as empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for x in batches:
            yield pd.Series(model(x.fillna("").tolist()))

    return df.withColumn("embedding", run(F.col(text)))


def embed_each(df: DataFrame, make: Callable[[], Embed] = stub_embedder, text: str = "document", batch: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """df with ``embedding`` (array of float) as ``embed`` makes it, each different text embedded once; null text as empty.

    Texts are known by 128 bits of their SHA-256 (which joins the vectors to the rows; a text that many rows have is one row of that side).
    A task gives its model ``batch`` texts at a time, those of like length together, as models pad them to the longest. profile: what executors of this
    stage need (GPUs, memory), if that is other than elsewhere; the pool is then theirs alone.
    """
    digest = F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32)
    rows = df.withColumn("__text", digest)
    one = rows.groupBy("__text").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = pa.array(model(part.column("t").to_pylist()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("__text"), vectors], names=["__text", "embedding"])

    by_length = one.sortWithinPartitions(F.length("t"), "__text")
    made = by_length.mapInArrow(run, "__text string, embedding array<float>", profile=profile)
    return rows.drop("embedding").join(made, "__text").drop("__text")


def generate(prompt: Column, make: Callable[[], Generate] = stub_generator, failed: str = "") -> Column:
    """The model's answer to each prompt; a prompt that is null has none, and one whose call fails gives ``failed``.

    A batch that fails is asked again prompt by prompt, so that only those answers fail that are themselves at fault.
    """

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for x in batches:
            there = x.notna()
            out = pd.Series([None] * len(x), index=x.index, dtype=object)
            out[there] = [failed if e else y for y, e, _ in answered(model, x[there].tolist())]
            yield out

    return run(prompt)


def answered(model: Generate, prompts: list[str], tries: list[int] | None = None) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, times asked) of each prompt, asked all at once and, if that fails, one by one, each as often as it may be (once)."""
    try:
        answers = model(prompts) if prompts else []
        if len(answers) == len(prompts):
            return [(y, None, 1) for y in answers]
    except Exception:  # a model's failure is an answer, not the job's
        pass
    out = []
    for x, most in zip(prompts, tries or [1] * len(prompts), strict=True):
        for used in range(1, max(1, most) + 1):
            try:
                answer, error = model([x])[0], None
                break
            except Exception as e:
                answer, error = None, f"{type(e).__name__}: {e}"
        out.append((answer, error, used))
    return out
