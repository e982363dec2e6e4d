"""Substring dedup: passages of 35 and more words that are found elsewhere too, by prefix-partitioned suffix trees.

Texts are first cut down to one of each (equal texts repeat each other whole). The suffixes that go into trees start at anchors: of the
10-word sequences in each window of 35 words that of least hash, wherever it starts. Equal windows have equal anchors, so each repeated
window is seen from one; an anchor is one word in about 13. Suffixes are partitioned by a prefix: the anchor's 10 words. A prefix that occurs once
has one leaf below it and is pruned. A prefix with at most GROUP_ROWS suffixes is a group that fits in memory: its suffixes, with the
words before them that windows can reach, come together in one task, which builds the group's tree as a sorted suffix array with the
lengths of common prefixes, and another over the reversed words before. Where two leaves below a node share d words from the anchor on and
another node puts the same two at d' words before it, they are one maximal repeat of d + d'; those of 35 and more give the spans. Words
themselves are compared. A prefix with more suffixes is too large for a group: its windows are partitioned by the longest prefix there
is any use for, all 35 words (as 128-bit hashes); such a group is one node, whose leaves are counted, not gathered. A task counts its own
first: of windows that it has twice it knows the spans already, and passes one on for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import Tables, chunks, fresh, settle, small

#: Words of an anchor's prefix, and the suffixes of one prefix that make a group.
PREFIX, GROUP_ROWS = 10, 2000
#: Suffixes whose trees are built at a time.
TREE_ROWS = 20_000
#: Windows of large prefixes that a task counts at a time.
HELD_WINDOWS = 300_000
KEPT_WORDS = 400_000
BASE = 0x9E3779B97F4A7C15 | 1


class Words:
    """64-bit hashes of words, the frequent ones kept."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.known.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = x = xxhash.xxh64_intdigest(words[i])
                    if len(self.known) < KEPT_WORDS:
                        self.known[words[i]] = x
        return np.array(out, np.uint64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n).bit_length()
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def sequence_hashes(words: np.ndarray, size: int, sums: np.ndarray) -> np.ndarray:
    """A hash of every ``size`` successive words."""
    n = len(words) - size + 1
    h = (sums[size:] - sums[:n]) * powers(len(words) + 1)[1][:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding(x: np.ndarray, width: int, function: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every ``width`` successive values."""
    step = 1
    while step * 2 <= width:
        x = function(x[step:], x[:-step])
        step *= 2
    rest = width - step
    return function(x[rest:], x[: len(x) - rest]) if rest else x


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchors of a text's windows start, and their prefixes' hashes, from the hashes of its words."""
    prefix = min(PREFIX, window)
    width = window - prefix + 1
    sums = np.concatenate((np.zeros(1, np.uint64), words * powers(len(words) + 1)[0][: len(words)])).cumsum(dtype=np.uint64)
    value = sequence_hashes(words, prefix, sums)
    least = sliding(value, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate((pad, least, pad)), width, np.maximum) == value)
    return at, value[at]


def common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sequences of numbers, and how many numbers each has in common with the one before it (the first none)."""
    octets = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(octets.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    some = rows[order]
    unlike = some[1:] != some[:-1]
    shared = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])
    return order, np.concatenate((np.zeros(1, np.int64), shared))


def tree_spans(texts: list[bytes], left: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): the repeated stretches of ``window`` words and more around the suffixes of some whole groups.

    texts: the words from ``left`` words before the suffix to its ``window``-th; at: where the suffix starts in its text.
    """
    n, reach = len(texts), window - min(PREFIX, window)
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in x.split()] for x in texts]
    # What lies beyond a text's ends equals nothing.
    own = len(numbers) + np.arange(n, dtype=np.uint32)[:, None]
    after, before = np.repeat(own, window, 1), np.repeat(own, max(1, reach), 1)
    for i, (x, k) in enumerate(zip(words, left.tolist(), strict=True)):
        after[i, : len(x) - k] = x[k:]
        before[i, :k] = x[:k][::-1]
    right = np.fromiter(map(len, words), np.int64, n) - left
    order, depth = common(after)
    order_before, depth_before = common(before)
    good = np.zeros((n, reach + 2), bool)
    for o in range(reach + 1):  # the window starts so many words before the suffix
        node = np.empty(n, np.int64)
        node[order] = np.cumsum(depth < window - o)
        if o:
            other = np.empty(n, np.int64)
            other[order_before] = np.cumsum(depth_before < o)
            node = node * (n + 1) + other
        rows = np.flatnonzero((left >= o) & (right >= window - o))
        leaf = node[rows]
        by = np.argsort(leaf, kind="stable")
        same = leaf[by][1:] == leaf[by][:-1]
        good[rows[by[1:][same]], o] = True
        good[rows[by[:-1][same]], o] = True
    edge = np.diff(good.astype(np.int8), axis=1, prepend=0)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return row, at[row] - past + 1, at[row] - first + window


LEAF = "kind int, prefix long, second long, ta long, tb long, at int, left int, words string"
#: Kinds of leaves: a suffix with its words; a window of a large prefix, as its hash, with how often it was seen; a span known to repeat.
SUFFIX, WINDOW, SPAN = 0, 1, 2


class Windows:
    """Windows of large prefixes that a task holds until they are counted."""

    def __init__(self, window: int):
        self.window, self.size = window, 0
        self.texts: list[tuple[int, int]] = []
        self.starts: list[np.ndarray] = []
        self.digests: list[bytes] = []

    def add(self, ta: int, tb: int, words: list[bytes], starts: np.ndarray) -> None:
        self.texts.append((ta, tb))
        self.starts.append(starts)
        self.digests += [xxhash.xxh3_128_digest(b" ".join(words[k : k + self.window])) for k in starts.tolist()]
        self.size += len(starts)

    def counted(self) -> pa.RecordBatch:
        """A window for all that are alike, and the spans of those that are so; nothing is held any more."""
        text = np.repeat(np.arange(len(self.starts)), list(map(len, self.starts)))
        start = np.concatenate(self.starts).astype(np.int64)
        hashes = np.frombuffer(b"".join(self.digests), "<i8").reshape(-1, 2)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        first = np.flatnonzero(np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]).any(1))))
        count = np.diff(np.append(first, len(order)))
        one = order[first]
        again = np.zeros(len(order), bool)
        again[order[np.repeat(count > 1, count)]] = True
        # Windows come by text and place: those that meet make one span.
        some = np.flatnonzero(again)
        apart = (text[some][1:] != text[some][:-1]) | (start[some][1:] > start[some][:-1] + self.window)
        begin, end = some[np.concatenate(([True], apart))] if len(some) else some, some[np.concatenate((apart, [True]))] if len(some) else some
        ids = np.array(self.texts, np.int64)
        rows = np.concatenate((one, begin))
        none = np.zeros(len(begin), np.int64)
        columns = [
            np.repeat([WINDOW, SPAN], [len(one), len(begin)]).astype(np.int32), np.concatenate((hashes[one, 0], none)), np.concatenate((hashes[one, 1], none)), ids[text[rows], 0], ids[text[rows], 1],
            start[rows].astype(np.int32), np.concatenate((count, start[end] + self.window)).astype(np.int32),
        ]
        self.__init__(self.window)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(rows), pa.string())], names=["kind", "prefix", "second", "ta", "tb", "at", "left", "words"])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def repeats(df: DataFrame, tables: Tables, text: str = "text", window: int = 35) -> tuple[DataFrame, DataFrame]:
    """df's texts as (ta, tb, t) beside its columns, and (ta, tb, copies, spans) of the texts that have repeated windows.

    ta, tb: 128 bits of hashes that tell texts apart. copies: rows with the text, all of which repeat if there are two or more (spans is
    then null). spans: array of word numbers (from, to), of 35 words at least each, overlapping where repeats do.
    """
    name = fresh(df, "t")
    rows = df.withColumn(name, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).select("*", F.xxhash64(name).alias("ta"), F.xxhash64(F.lit(1), F.col(name)).alias("tb")).withColumnRenamed(name, "t")
    bare = rows.select("ta", "tb", "t")
    many = settle(bare.groupBy("ta", "tb").agg(F.count("*").alias("copies")).where("copies > 1"))
    listed = small(many.select("ta", "tb"))
    first = tables.settle(bare.join(listed, ["ta", "tb"], "left_semi").groupBy("ta", "tb").agg(F.first("t").alias("t")))
    once = bare.join(listed, ["ta", "tb"], "left_anti").unionByName(first)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for a, b, texts in chunks(batch, "t", 1_000_000):
                out, counts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], []
                for x in texts:
                    words = x.split()
                    counts.append(0)
                    if len(words) >= window:
                        out.append(anchors(known.hashes(words), window))
                        counts[-1] = len(out[-1][0])
                at, prefix = (np.concatenate(x) for x in zip(*out, strict=True))
                ids = [np.repeat(batch.column(x).slice(a, b - a).to_numpy(), counts) for x in ("ta", "tb")]
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), *map(pa.array, ids), pa.array(at.astype(np.int32))], names=["prefix", "ta", "tb", "at"])

    found = tables.settle(once.mapInArrow(prefixes, "prefix long, ta long, tb long, at int"))
    inner = tables.settle(found.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix", (F.col("n") > GROUP_ROWS).alias("large")))
    places = tables.settle(found.join(small(inner), "prefix").groupBy("ta", "tb").agg(F.collect_list(F.struct("prefix", "at", "large")).alias("places")))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes with their words, and windows and spans of large prefixes."""
        reach = window - min(PREFIX, window)
        held = Windows(window)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for a, b, texts in chunks(batch, "t", 200_000):
                out: list[list] = [[] for _ in kinds]
                ids = [batch.column(x).slice(a, b - a).to_pylist() for x in ("ta", "tb")]
                for x, ta, tb, spots in zip(texts, *ids, batch.column("places").slice(a, b - a), strict=True):
                    words = x.split()
                    prefix, at, large = (spots.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    for p, k in zip(prefix[~large].tolist(), at[~large].tolist(), strict=True):
                        left = min(k, reach)
                        for column, value in zip(out, (SUFFIX, p, 0, ta, tb, k, left, b" ".join(words[k - left : k + window])), strict=True):
                            column.append(value)
                    starts = np.unique((at[large][:, None] - np.arange(reach + 1)[None, :]).ravel())
                    starts = starts[(starts >= 0) & (starts <= len(words) - window)]
                    if len(starts):
                        held.add(ta, tb, words, starts)
                columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=["kind", "prefix", "second", "ta", "tb", "at", "left", "words"])
                if held.size >= HELD_WINDOWS:
                    yield held.counted()
        if held.size:
            yield held.counted()

    texts = once.join(small(places.select("ta", "tb")), ["ta", "tb"], "left_semi").join(places, ["ta", "tb"])
    leaf = tables.settle(texts.select("ta", "tb", "t", "places").mapInArrow(leaves, LEAF))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by prefix: whole groups, some at a time."""

        def spans(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(part).combine_chunks()
            left, at = (table.column(x).to_numpy().astype(np.int64) for x in ("left", "at"))
            row, start, end = tree_spans(table.column("words").cast(pa.binary()).to_pylist(), left, at, window)
            ids = [pa.array(table.column(x).to_numpy()[row]) for x in ("ta", "tb")]
            return pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["ta", "tb", "from", "to"])

        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for whole in batches:
            prefix = whole.column("prefix").to_numpy()
            cuts = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)] if len(prefix) else [0]
            begin = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                if count + a - begin >= TREE_ROWS and prefix[a] != last:
                    yield spans([*held, *([whole.slice(begin, a - begin)] if a > begin else [])])
                    held, count, begin = [], 0, a
                last = prefix[a]
            if len(prefix) > begin:
                held.append(whole.slice(begin))
                count += len(prefix) - begin
        if held:
            yield spans(held)

    grouped = leaf.where(F.col("kind") == SUFFIX).select("prefix", "ta", "tb", "at", "left", "words").repartition("prefix").sortWithinPartitions("prefix")
    span = "ta long, tb long, from int, to int"
    windows = leaf.where(F.col("kind") == WINDOW)
    nodes = tables.settle(windows.groupBy("prefix", "second").agg(F.sum("left").alias("n")).where("n > 1").drop("n"))
    large = windows.join(small(nodes), ["prefix", "second"], "left_semi").select("ta", "tb", F.col("at").alias("from"), (F.col("at") + window).alias("to"))
    known = leaf.where(F.col("kind") == SPAN).select("ta", "tb", F.col("at").alias("from"), F.col("left").alias("to"))
    spans = tables.settle(grouped.mapInArrow(trees, span).unionByName(large).unionByName(known)).groupBy("ta", "tb").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    spans = spans.join(listed, ["ta", "tb"], "left_anti").select("ta", "tb", F.lit(1).cast("long").alias("copies"), "spans")
    return rows, settle(spans.unionByName(many.select("ta", "tb", "copies", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))))


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 35, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (keep_text) the kept words joined by one space, of each row.

    Every word that a repeated window covers is removed, in all its places. Null text has no words; texts of fewer than ``window`` words
    keep all. Repeated rows are copies of each other. An empty table gives an empty table; other columns are left out, so their names
    don't matter.
    """
    tables = Tables(df.sparkSession)
    rows, found = repeats(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), tables, "text", window)
    tables.drop()
    kind = rows.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("n_words", T.LongType()), StructField("n_removed", T.LongType()), StructField("kept_sha256", T.StringType()), *[StructField("kept", T.StringType())] * keep_text])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, "t"):
                n, removed, kept = [], [], []
                for x, copies, spans in zip(texts, batch.column("copies").slice(a, b - a).to_pylist(), batch.column("spans").slice(a, b - a), strict=True):
                    words = x.split()
                    n.append(len(words))
                    if copies > 1 and len(words) >= window:
                        words = []
                    elif spans.is_valid:
                        gone = covered(len(words), *(spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(2)))
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                out = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, names=schema.fieldNames())

    listed = small(found.select("ta", "tb"))
    none = found.schema["spans"].dataType
    plain = rows.join(listed, ["ta", "tb"], "left_anti").select("doc_id", "t", F.lit(1).cast("long").alias("copies"), F.lit(None).cast(none).alias("spans"))
    touched = rows.join(listed, ["ta", "tb"], "left_semi").join(found, ["ta", "tb"]).select("doc_id", "t", "copies", "spans")
    return plain.unionByName(touched).mapInArrow(cut, schema)
