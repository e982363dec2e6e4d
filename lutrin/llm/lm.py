"""Language-model scoring by prediction by partial matching over bytes.

The trie of contexts of up to ORDER bytes is trained on the whole training text: each byte is coded by the longest context that has
been seen with it, after escapes (method C: as often as the context has seen different bytes) from longer ones, whose bytes are
excluded. A text's score is the sum over its bytes, A-Z lower-cased, and an end. The trie comes as counts of (ORDER + 1)-byte sequences from Spark;
the driver gets a part of about GRAMS of them at a time, by the last two bytes of the context, on which all longer contexts of a place depend,
and sends its tables to the workers. A worker has one part in memory at a time: it looks up a chunk's different sequences in each part in turn.

The word-unigram score beside it uses counts of all words: those of the most frequent HEAD words are sent to the workers, the others
are joined by word, so all are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, scratch, settle

ORDER = 5
#: Sequences of a part of the trie (about 100 bytes each in a worker), and most frequent words.
GRAMS, HEAD = 500_000, 100_000
#: Text whose sequences are looked up together.
LOOKED_UP_BYTES = 2_000_000
#: Different sequences or words that a training task gathers before it passes them on.
GATHERED = 1_000_000
END, PAD = 0xFF, 0xFE  # bytes that UTF-8 never has


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each byte (and end mark) of the texts, as numbers, and where texts end."""
    pad = bytes([PAD]) * ORDER
    flat = np.frombuffer(b"".join(pad + x.lower() + bytes([END]) for x in texts), np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(flat) - ORDER), np.int64)
    for i in range(ORDER + 1):
        out |= flat[i : len(flat) - ORDER + i] << (8 * (ORDER - i))
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(size + ORDER)[:-1])) if len(texts) else size
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    return out[at], np.cumsum(size)


class Table:
    """Numbers to values, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (len(keys) * 4 // 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros((1 << self.bits, *values.shape[1:]), values.dtype)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[left]]
            there[left] = got
            left = left[(got != keys[left]) & (got != -1)]
        return np.where(there == keys, slot, -1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Model:
    """keys, counts: (ORDER + 1)-byte sequences; pairs, pair_counts: all two-byte ones, as a part doesn't have them all."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray):
        levels: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts)] * (ORDER + 1)
        for j in range(ORDER, -1, -1):  # sequences of j + 1 bytes
            source = levels[j + 1] if j < ORDER and j != 1 else (pairs, pair_counts) if j == 1 and ORDER > 1 else (keys, counts)
            levels[j] = _sums(source[0] & ((1 << 8 * (j + 1)) - 1), source[1])
        self.nodes: list[Table] = []
        self.counts: list[Table] = []
        below: tuple[np.ndarray, ...] = ()
        for j, (k, c) in enumerate(levels):
            context = k >> 8
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(k) else np.zeros(0, np.int64)
            different = np.diff(np.append(first, len(k)))
            total = np.add.reduceat(c, first) if len(first) else first
            # Occurrences, different bytes; and both after the context that is a byte shorter, without this one's bytes.
            node = np.zeros((len(first), 4), np.float32)
            node[:, 0], node[:, 1] = total, different
            if j and len(first):
                keys_below, counts_below, contexts_below, total_below, different_below = below
                at = np.searchsorted(keys_below, k & ((1 << 8 * j) - 1))
                up = np.searchsorted(contexts_below, context[first] & ((1 << 8 * (j - 1)) - 1))
                node[:, 2] = total_below[up] - np.add.reduceat(counts_below[at], first)
                node[:, 3] = different_below[up] - different
            self.nodes.append(Table(context[first], node))
            if j < ORDER:
                self.counts.append(Table(k, c.astype(np.float32)))
            else:
                top = np.log10(c / np.repeat(total + different, different)) if len(k) else np.zeros(0)
                self.counts.append(Table(k, top.astype(np.float32)))
            below = (k, c, context[first], total, different)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each sequence after the others."""
        top = self.counts[ORDER]
        slot = top.find(gram)
        out = top.values[slot].astype(np.float64)
        left = np.flatnonzero(slot < 0)
        some, at = np.unique(gram[left], return_inverse=True)
        out[left] = self._escaped(some)[at]
        return out

    def _escaped(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        above = np.zeros((len(gram), 2))  # occurrences and different bytes left when those of the longer context are excluded
        longer = np.zeros(len(gram), bool)  # whether the longer context is known
        taken = np.zeros(len(gram))
        live = np.arange(len(gram))
        for j in range(ORDER, -1, -1):
            part = gram[live] & ((1 << 8 * (j + 1)) - 1)
            slot = self.nodes[j].find(part >> 8)
            node = self.nodes[j].values[slot].astype(np.float64)
            known = slot >= 0
            n, d = np.where(longer[live][:, None], above[live], node[:, :2]).T
            if j < ORDER:
                hit = self.counts[j].find(part)
                coded = known & (hit >= 0)
                out[live[coded]] += np.log10(self.counts[j].values[hit[coded]] / (n + d)[coded])
            else:
                coded = np.zeros(len(live), bool)
            escape = known & ~coded & (d > 0)
            out[live[escape]] += np.log10(d[escape] / (n + d)[escape])
            above[live], taken[live], longer[live] = node[:, 2:], np.where(known, node[:, 1], 0), known
            live = live[~coded]
        out[live] -= np.log10(256 - taken[live])
        return out


def _part(context: Column | np.ndarray, parts: int):
    """The part of the trie that a context's last two bytes are in."""
    if isinstance(context, Column):
        return F.pmod(F.shiftright(context.bitwiseAND(F.lit(0xFFFF)) * F.lit(2654435761), 16), F.lit(parts))
    return ((context & 0xFFFF) * 2654435761 >> 16) % parts


def train(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the counts of byte sequences (gram, c) and of words (word, c) over all rows.

    Null and empty texts count as an end alone; repeated rows count as often as they are there; other columns aren't looked at. An empty table gives
    empty tables.
    """
    base = df.select(F.col(text).alias("t"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, texts in chunks(batch, "t"):
                k, c = np.unique(grams(texts)[0], return_counts=True)
                keys, counts = _sums(np.concatenate((keys, k)), np.concatenate((counts, c)))
                if len(keys) >= GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "c"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "c"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(found.items())
            for i in range(0, len(items), 100_000):
                part = items[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "c"])
            found.clear()

        for batch in batches:
            for _, _, texts in chunks(batch, "t"):
                for x in texts:
                    found.update(x.lower().split())
                if len(found) >= GATHERED // 2:
                    yield from out()
        yield from out()

    seen = base.mapInArrow(sequences, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    vocabulary = base.mapInArrow(words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return settle(seen), settle(vocabulary)


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return tuple(table.column(i).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))  # type: ignore[return-value]


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: of each row, learning from those not held out.

    Tokens are words and an end; null text is empty. held_out: by default crc32 of the id's text modulo 5 is 1; rows where it is
    null (a null id) are learnt from. Repeated rows count as often as they are there. Without rows to learn from, all bytes are
    alike likely and counts are 0. An empty table gives an empty table. Other columns are left out.
    """
    spark = df.sparkSession
    if held_out is None:
        held_out = F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 1
    base = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    learn = base.where("not held_out")
    seen, vocabulary = train(learn, "t")
    n_grams = seen.count()
    parts = max(1, -(-n_grams // GRAMS))
    pairs = _arrays(seen.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("c").alias("c")))
    total, types = vocabulary.agg(F.sum("c"), F.count("*")).first()
    texts = int(pairs[1][pairs[0] & 0xFF == END].sum())
    tokens, types = (total or 0) + texts, types + (texts > 0)
    frequent = vocabulary.orderBy(F.desc("c"), "word").limit(HEAD).select(F.col("word").cast("binary"), "c").toArrow()
    head = spark.sparkContext.broadcast((frequent.column(0).to_pylist(), frequent.column(1).to_numpy()))
    del frequent
    down = tokens + 0.5 * (types + 1)

    placed = seen.withColumn("part", _part(F.shiftright("gram", 8), parts))
    if parts > 1:  # each part is read from its own files
        path = scratch(spark)
        placed.repartition(parts, "part").write.partitionBy("part").parquet(path)
        placed = spark.read.schema(placed.schema).parquet(path)
    sent = [spark.sparkContext.broadcast(Model(*_arrays(placed.where(F.col("part") == part).select("gram", "c")), *pairs)) for part in range(parts)]

    def log10(gram: np.ndarray) -> np.ndarray:
        """Of each sequence, by the parts in turn."""
        if parts == 1:
            return sent[0].value.log10(gram)
        different, at = np.unique(gram, return_inverse=True)
        part = _part(different >> 8, parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        value = np.zeros(len(different))
        for i, one in enumerate(sent):
            mine = order[ends[i] : ends[i + 1]]
            if len(mine):
                value[mine] = one.value.log10(different[mine])
                release(one)
        return value[at]

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, "t", 1_000_000 if parts == 1 else LOOKED_UP_BYTES):
                gram, ends = grams(texts)
                each = np.add.reduceat(log10(gram), np.concatenate(([0], ends[:-1])))
                rows = batch.slice(a, b - a)
                yield rows.set_column(3, "score", pa.array(each))

    now = base.select("doc_id", "held_out", "t", F.lit(0.0).alias("score"))
    now = now.mapInArrow(bytes_of, now.schema)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word's term is worked out once for all texts; rarer words are passed on.
        terms = dict(zip(head.value[0], np.log10((head.value[1] + 0.5) / down).tolist(), strict=True))
        end = float(np.log10((texts + 0.5) / down))
        for batch in batches:
            for a, b, rows in chunks(batch, "t"):
                n, known, sums, rest, many = [], [], [], [], []
                for x in rows:
                    w = x.lower().split()
                    values = list(map(terms.get, w))
                    rare = Counter(y for y, v in zip(w, values, strict=True) if v is None)
                    n.append(len(w) + 1)
                    known.append(len(w) - sum(rare.values()) + (texts > 0))
                    sums.append(sum(v for v in values if v is not None) + end)
                    rest.append(list(rare))
                    many.append(list(rare.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in (0, 1, 3)]
                    + [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(rest, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(many, pa.list_(pa.int64()))],
                    names=["doc_id", "held_out", "score", "n_tokens", "head_known", "head_sum", "rest", "many"],
                )

    kind = base.schema["doc_id"].dataType.simpleString()
    scored = now.mapInArrow(words, f"doc_id {kind}, held_out boolean, score double, n_tokens long, head_known long, head_sum double, rest array<string>, many array<long>")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()))  # written once, so its numbers hold
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "many")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.many").alias("m"))
    rare = rare.join(vocabulary, "word", "left")
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(down)))
    rare = rare.groupBy("row").agg(F.sum(F.col("m") * term).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    out = scored.select("row", "doc_id", "held_out", "score", "n_tokens", "head_known", "head_sum").join(rare, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0))).alias("base_score"), "score")
