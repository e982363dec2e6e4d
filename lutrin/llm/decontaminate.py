"""Benchmark decontamination by an FM-index of each training shard.

A shard is about 4 MB of document text inside one task. Its words become numbers of the benchmark's vocabulary;
stretches of at least a window's length without other words, which are all that a window can occur in, are joined
with separators and indexed: suffix array, Burrows-Wheeler transform, wavelet matrix with ranks, and a sample of
suffix positions. All windows whose words are all in the shard are then searched backwards at once, occurrences are located by
walking to sampled positions, and overlapping occurrences in a document are merged into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import chunks, fresh, others, release

SHARD_BYTES = 4_000_000
#: Benchmark text that a worker has in memory at once; a larger benchmark goes in several blocks, which each shard meets in turn.
BLOCK_BYTES = 8_000_000
SAMPLE_RATE = 8
#: ASCII letters, digits and all bytes above ASCII are of words; A-Z become a-z; the rest separates.
WORD_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; only those still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    step = 1
    while True:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        some = order[at]
        group = rank[some]
        after = rank[np.minimum(some + step, n)]
        by = np.lexsort((after, group))
        order[at] = some[by]
        group, after = group[by], after[by]
        first[at[1:]] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        first[at[0]] = True
        heads = first[at]
        rank[order[at]] = at[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
        step *= 2


class FMIndex:
    """Counts and places of word patterns in a sequence of numbers below ``size``; 0 separates."""

    def __init__(self, text: np.ndarray, size: int, rate: int = SAMPLE_RATE):
        text = np.concatenate((text + 1, [0]))  # the end sorts first
        self.n = n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size + 1))))
        self.bits = max(1, int(size).bit_length())
        self.zeros, self.ranks, self.planes = [], [], []
        level = bwt
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            self.planes.append(bit.astype(np.int8))
            self.ranks.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.sampled = sa % rate == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = sa[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` of the transform."""
        low, high = np.zeros_like(at), at
        for i, b in enumerate(reversed(range(self.bits))):
            one = (symbol >> b) & 1 == 1
            ones, z = self.ranks[i], self.zeros[i]
            low_one, high_one = ones[low], ones[high]
            low = np.where(one, z + low_one, low - low_one)
            high = np.where(one, z + high_one, high - high_one)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for i in range(self.bits):
            bit = self.planes[i][at]
            ones = self.ranks[i][at]
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
            out = out << 1 | bit
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row; the rows are of one length."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            c = patterns[live, j].astype(np.int64) + 1
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the sequence of suffixes given by their order."""
        out = np.empty(len(at), np.int64)
        walk, steps, at = np.arange(len(at)), np.zeros(len(at), np.int64), at.astype(np.int64)
        while len(walk):
            found = self.sampled[at]
            out[walk[found]] = self.samples[self.sample_rank[at[found]]] + steps[found]
            walk, at, steps = walk[~found], at[~found], steps[~found] + 1
            c = self.symbol(at)
            at = self.before[c] + self.rank(c, at)
        return out


class Phrases:
    """The windows of benchmark items: ``window`` words each, or a whole item of fewer, as rows of numbers of words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [x for x, _ in items]
        by_size: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                part = by_size.setdefault(rows.shape[1], ([], []))
                part[0].append(rows)
                part[1].append(np.full(len(rows), k, np.int32))
        self.least = min(by_size, default=0)
        #: Of each length: the different rows; where each one's items begin; the items.
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, (rows, of) in sorted(by_size.items()):
            different, row = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((row.ravel(), np.concatenate(of)), 1), axis=0)
            self.by_length.append((n, different, np.searchsorted(pairs[:, 0], np.arange(len(different) + 1)), pairs[:, 1].astype(np.int32)))

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: its words, merged spans of word numbers [from, to), items."""
        get = self.vocabulary.get
        counts, ids = [], []
        for x in texts:
            w = words(x)
            counts.append(len(w))
            ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
            ids.append(np.zeros(1, np.int32))
        out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(n, [], set()) for n in counts]
        if not self.least:
            return out
        flat = np.concatenate(ids)
        known = np.concatenate(([0], (flat > 0).view(np.int8), [0]))
        edge = np.diff(known)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        size = end - begin + 1  # with the separator
        source = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        index = FMIndex(flat[source].astype(np.int64), len(self.vocabulary) + 1)
        first = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
        found: dict[int, list[tuple[int, int]]] = {}
        here = np.zeros(len(self.vocabulary) + 2, bool)
        here[flat[source]] = True
        for n, rows, starts, items in self.by_length:
            some = np.flatnonzero(here[rows].all(1))
            low, high = index.search(rows[some])
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            many = high[hit] - low[hit]
            at = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            place = source[index.locate(at)]
            doc = np.searchsorted(first, place, "right") - 1
            for d, p, r in zip(doc.tolist(), (place - first[doc]).tolist(), np.repeat(some[hit], many).tolist(), strict=True):
                found.setdefault(d, []).append((p, p + n))
                out[d][2].update(self.items[x] for x in items[starts[r] : starts[r + 1]].tolist())
        for d, spans in found.items():
            out[d] = (out[d][0], merged(spans), out[d][2])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between kept words stays."""
    places = [m.span() for m in re.finditer(rb"[^\s]+", text.translate(WORD_TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def find_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, clean: str | None = None) -> DataFrame:
    """df with ``n_words``, ``spans`` (array of word numbers [from, to), merged) and ``items`` (sorted item ids as strings).

    clean: also give the text without the spans, under this name (it may be the text column's own).
    Null text has no words; in ``clean`` it stays null. Items without a word, or null, have no windows; a null id is the
    empty string. An empty table or benchmark works and hits nothing. Columns of df with the new names, in any case, are replaced, others
    stay; repeated rows give repeated rows. A benchmark above BLOCK_BYTES is worked through in blocks, one after the other over each
    shard in the same worker.
    """
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    sent = []
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        sent.append(spark.sparkContext.broadcast(Phrases([(r.i, r.t.encode()) for r in part.toLocalIterator()], window)))
    source = fresh(df, "text")
    new = ("spans", "items", "n_words")
    kept = others(df, {*new, *([clean] if clean else [])})
    order = [StructField(clean, T.StringType()) if clean and f.name.lower() == clean.lower() else f for f in others(df, new)]
    if clean and clean not in [f.name for f in order]:
        order.append(StructField(clean, T.StringType()))
    span = T.ArrayType(T.StructType([StructField("from", T.LongType()), StructField("to", T.LongType())]))
    schema = StructType([*order, StructField("spans", span), StructField("items", T.ArrayType(T.StringType())), StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b, texts in chunks(whole, source, SHARD_BYTES):
                batch = whole.slice(a, b - a)
                found: list[tuple[int, list[tuple[int, int]], set[str]]] = []
                for one in sent:
                    hits = one.value.hits(texts)
                    found = [(n, merged([*x, *y]) if x else y, z | w) for (n, x, z), (_, y, w) in zip(found, hits, strict=True)] if found else hits
                    if len(sent) > 1:
                        release(one)
                spans = [x for _, x, _ in found]
                columns = {
                    "spans": pa.array([[{"from": x, "to": y} for x, y in s] for s in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                    "items": pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string())),
                    "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                }
                if clean:
                    columns[clean] = cut(batch.column(source), texts, spans)
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch.column(f.name) for f in schema.fields], names=schema.fieldNames())

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)


def cut(column: pa.Array, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts without their spans; the column itself if none has any."""
    if not any(spans):
        return column
    whole = column.is_valid().to_pylist()
    return pa.array([(without(x, s) if s else x).decode() if ok else None for x, s, ok in zip(texts, spans, whole, strict=True)], pa.string())
