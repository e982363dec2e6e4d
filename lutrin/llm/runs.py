"""Periodic runs of words, found by naming all stretches of power-of-two lengths (Karp, Miller and Rosenberg).

Words are numbered, then stretches of 2, 4, 8 ... words: two stretches of one length have one name if and only if they are
equal, as names are numbers of pairs of names of half the length. Common extensions of two places follow by descending levels, in one NumPy
step for all pairs. A run of period q is at least 3 * q words long, so some multiple of q lies in its first q words, where it equals what
follows q later; those grid places, n/q for each q, are tested by names and the ones that hold are extended. There
are neither hashes of stretches nor suffixes. Each document is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import chunks, fresh, others

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 24, 3
#: Grid places that are tested at once, for memory's sake.
GRID = 1 << 20
RUNS = T.ArrayType(T.StructType([StructField(x, T.LongType(), False) for x in ("start", "length", "period")]), False)
Edit = Callable[[list[bytes], object], list[bytes]]


def names(ids: np.ndarray, top: int, below: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Level k has the names of all stretches of 2**k words, up to level ``top``; ``below``: levels that are known."""
    levels = below or [ids.astype(np.int32)]
    while len(levels) <= top:
        last, half = levels[-1], 1 << (len(levels) - 1)
        pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
    return levels


def _extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on equal those from j on (i < j); with back, how many before i those before j."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, level, live = 1 << k, levels[k], np.arange(len(i))
        while len(live):
            a, b = (i[live] - out[live] - width, j[live] - out[live] - width) if back else (i[live] + out[live], j[live] + out[live])
            there = a >= 0 if back else b + width <= n
            live, a, b = live[there], a[there], b[there]
            live = live[level[a] == level[b]]
            out[live] += width
            if k < len(levels) - 1:  # what is left is shorter than two of these
                break
    return out


def find(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of numbered words, by start, then period."""
    n, none = len(ids), np.zeros((0, 3), np.int64)
    if n < LEAST:
        return none
    # A run has the same LEAST // TIMES words at two places: without such, no name of that level comes twice.
    first = (LEAST // TIMES).bit_length() - 1
    levels = names(ids, first)
    if int(levels[first].max()) + 1 == len(levels[first]):
        return none
    most = n // TIMES
    levels = names(ids, most.bit_length() - 1, levels)
    found = []
    for k in range(most.bit_length()):
        level, width = levels[k], 1 << k
        low, high = width, min(most, 2 * width - 1)
        step = max(1, GRID // (n // low))
        for at in range(low, high + 1, step):
            periods = np.arange(at, min(high, at + step - 1) + 1)
            count = n // periods - 1
            q = np.repeat(periods, count)
            i = (np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)) * q
            same = level[i] == level[i + q]
            i, q = i[same], q[same]
            same = level[i + q - width] == level[i + 2 * q - width]
            i, q = i[same], q[same]
            if not len(i):
                continue
            start = i - _extend(levels, i, i + q, True)
            end = i + 2 * q + _extend(levels, i + q, i + 2 * q, False)
            long = end - start >= np.maximum(LEAST, TIMES * q)
            found.append(np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0))
    if not found:
        return none
    # One stretch that several periods fit has the least as its own.
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)]]
    rows[:, 1] -= rows[:, 0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def collapse(df: DataFrame, text: str = "text", doc_id: str = "doc_id", edit: Edit | None = None) -> DataFrame:
    """df with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, in place of columns of those names.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of LEAST words and TIMES periods at least in which words that are its smallest period
    apart are equal and which can't be extended. ``collapsed`` has the words, joined by one space, without those of runs after each one's
    first period. Null and empty texts have no words and no runs; repeated rows are worked on alike. A row's whole text is in one
    task, with some 4 bytes a word for each level (the logarithm of its words). edit: is given the words and the row's doc_id, and what it returns is searched
    instead.
    """
    made = ("n_words", "runs", "collapsed")
    source, key = fresh(df, "text"), fresh(df, "id")
    kept = others(df, made)
    schema = StructType([*kept, StructField("n_words", T.LongType()), StructField("runs", RUNS), StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]))
        for batch in batches:
            for a, b, texts in chunks(batch, source):
                part = batch.slice(a, b - a)
                counts, lists, out = [], [], []
                for x, own in zip(texts, part.column(key).to_pylist(), strict=True):
                    words = x.split()
                    if edit:
                        words = edit(words, own)
                    runs = find(numbered(words)) if len(words) >= LEAST else np.zeros((0, 3), np.int64)
                    if len(runs):
                        stay = kept_words(len(words), runs)
                        words, n = [w for w, s in zip(words, stay.tolist(), strict=True) if s], len(words)
                    else:
                        n = len(words)
                    counts.append(n)
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    out.append(b" ".join(words))
                made = [pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *made], names=schema.fieldNames())

    columns = [F.col(f"`{f.name}`") for f in kept]
    return df.select(*columns, F.col(f"`{text}`").cast("string").alias(source), F.col(f"`{doc_id}`").alias(key)).mapInArrow(run, schema)
