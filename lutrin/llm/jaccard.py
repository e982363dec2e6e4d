"""An exact similarity join of documents by the Jaccard similarity of their word n-grams, with signature trees.

A set's signature is a bitmap of its elements' hashes. Leaves of a tree are sets; a node above has its children's bitmaps combined by OR, the
range of their sizes, and the most elements that share bits in one of them. Two trees are traversed together: a pair of nodes goes on
only if sizes allow the similarity and the greatest overlap that the bitmaps admit is enough for it; what is left of the pairs of
sets is compared element by element. One tree over all documents would be compared with itself by one task and its upper bitmaps would be
full, so the sets are first dealt to groups that any two alike share (``groups.part_keys``), and each group has a tree of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, chunks, settle, small
from .groups import alike, in_blocks, join_groups, meet, part_keys, shared_keys
from .simhash import BROADCAST_PRINTS, hashes_of

#: Longs of a signature, and children of a node.
LONGS, FAN = 32, 8
#: Pairs of nodes that are tested at once.
PAIRS = 50_000


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set of hashes, as LONGS longs."""
    out = np.zeros(64 * LONGS, bool)
    out[(hashes >> np.uint64(32)).astype(np.int64) % (64 * LONGS)] = True
    return np.packbits(out, bitorder="little").view("<u8")


class Tree:
    """Levels of nodes from the sets up: bits, least and greatest size, most elements without a bit of their own, least and greatest root."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        self.order = np.lexsort((*bits.T[:4], sizes))
        bits, sizes, roots = bits[self.order], sizes[self.order], roots[self.order]
        slack = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, slack, roots, roots)]
        while len(self.levels[-1][0]) > 1:
            last = self.levels[-1]
            at = np.arange(0, len(last[0]), FAN)
            kinds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(kinds, last, strict=True)))


def may_link(a: tuple, b: tuple, similarity: Fraction) -> np.ndarray:
    """For nodes (or sets) side by side: whether some pair below them, of different roots, may have the similarity."""
    p, q = similarity.numerator, similarity.denominator
    (x, low, high, slack, first, last), (y, low2, high2, slack2, first2, last2) = a, b
    sizes = (high * q >= p * low2) & (high2 * q >= p * low) & ~((first == last) & (first2 == last2) & (first == first2))
    most = np.minimum(slack, slack2) + np.bitwise_count(x & y).sum(1)
    most = np.minimum(most, np.minimum(high, high2))
    return sizes & (most * (p + q) >= p * (low + low2))


def traverse(one: Tree, two: Tree, similarity: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in one's sets and in two's) of pairs of sets that may have the similarity; if the trees are one, each pair once."""
    tops = len(one.levels) - 1, len(two.levels) - 1
    todo = [(*tops, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, m, i, j = todo.pop()
        if len(i) > PAIRS:
            todo += [(k, m, i[PAIRS:], j[PAIRS:]), (k, m, i[:PAIRS], j[:PAIRS])]
            continue
        keep = may_link(tuple(x[i] for x in one.levels[k]), tuple(x[j] for x in two.levels[m]), similarity)
        i, j = i[keep], j[keep]
        if not k and not m:
            if one is two:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield one.order[i], two.order[j]
            continue
        deep, deep2 = k >= m, m >= k
        if deep:
            k -= 1
            i, j = _children(i, j, len(one.levels[k][0]))
        if deep2:
            m -= 1
            j, i = _children(j, i, len(two.levels[m][0]))
        if one is two and k == m:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            todo.append((k, m, i, j))


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    below = (i[:, None] * FAN + np.arange(FAN)).ravel()
    there = below < n
    return below[there], np.repeat(j, FAN)[there]


def _candidates(similarity: Fraction) -> Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]:
    def pairs(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, roots, n = (table.column(x).to_numpy() for x in ("id", "root", "size"))
        bits = table.column("v").combine_chunks().values.to_numpy().view(np.uint64).reshape(-1, LONGS)
        one = Tree(bits[left], n[left], roots[left])
        two = one if left is right else Tree(bits[right], n[right], roots[right])
        for i, j in traverse(one, two, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[i]]), pa.array(ids[right[j]])], names=["a", "b"])

    return pairs


def _near(similarity: Fraction) -> Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]:
    """A test for ``groups.meet``: the bound of ``may_link`` on sets."""

    def test(n: int, own: np.ndarray, sizes: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        x, y = own.view(np.uint64), np.stack(others).view(np.uint64)
        nodes = lambda b, s: (b, s, s, s - np.bitwise_count(b).sum(1), np.zeros(len(s), np.int64), np.arange(1, len(s) + 1))
        return may_link(nodes(np.broadcast_to(x, y.shape), np.full(len(y), n, np.int64)), nodes(y, sizes.astype(np.int64)), similarity)

    return test


def numbered(base: DataFrame, tables: Tables) -> DataFrame:
    """base with ``id``, a number of each row: the doc_id, if no two rows have the same and none has none; else the rows are written with one."""
    if base.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        if not base.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
            return base.withColumn("id", F.col("doc_id").cast("long"))
    return tables.settle(base.withColumn("id", F.monotonically_increasing_id()))


def link(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, similarity: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles (long) and component_id, the least doc_id reached over links, for every row of df.

    A row's set has its distinct shingles of ``size`` words, lower-cased (A-Z); fewer words are one shingle, none an empty set, which links
    with nothing. Two rows link if their sets' Jaccard similarity is ``similarity`` or more; all such links are found. Null texts are
    empty. A null doc_id links like any other and is a component's id only if all of the component's are null; repeated rows and ids are
    rows of their own. An empty table gives an empty table; other columns are left out. Shingles are known by 64-bit hashes, whole sets by
    128 bits. Equal sets are one from the start.
    """
    tables = Tables(df.sparkSession)
    base = numbered(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")), tables)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, "t"):
                hashes = [hashes_of(x, size, distinct=True) for x in texts]
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h) for h in hashes), "<i8").reshape(-1, 2)
                n = np.fromiter(map(len, hashes), np.int64, len(hashes))
                keys = pa.array(part_keys(hashes, similarity), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), pa.array(whole[:, 0]), pa.array(whole[:, 1]), keys], names=["id", "n", "x", "y", "keys"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, "t", 500_000):
                hashes = [hashes_of(x, size, distinct=True) for x in texts]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in ([signature(h).view(np.int64) for h in hashes], [h.view(np.int64) for h in hashes])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(list(map(len, hashes)), pa.int64()), *lists], names=["id", "n", "v", "s"])

    made = tables.settle(base.select("id", "t").mapInArrow(sets, "id long, n long, x long, y long, keys array<long>"))
    some = made.where("n > 0")
    equal = tables.settle(some.groupBy("x", "y").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    same = tables.settle(some.select("id", "x", "y").join(small(equal), ["x", "y"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    keyed = some.join(small(same.select(F.col("b").alias("id"))), "id", "left_anti").select("id", F.explode("keys").alias("key"))
    shared = tables.settle(shared_keys(keyed))
    shared = tables.settle(shared.join(small(shared.groupBy("key").agg(F.count("*").alias("n"))), "key"))
    rows = tables.settle(base.select("id", "t").join(small(shared.select("id").distinct()), "id", "left_semi").mapInArrow(prints, "id long, n long, v array<long>, s array<long>"))

    def check(pairs: DataFrame) -> DataFrame:
        near = tables.settle(meet(pairs, rows.select("id", "n", "v"), _near(similarity)))
        return tables.settle(meet(near, rows.select("id", "n", F.col("s").alias("v")), alike(similarity)))

    def compare(rest: DataFrame) -> DataFrame:
        own = small(rows.select("id", F.col("n").alias("size"), "v"), BROADCAST_PRINTS)
        return in_blocks(rest.join(own, "id"), _candidates(similarity))

    roots = join_groups(tables, shared, same, check, compare).withColumnRenamed("node", "id")
    ids = base.select("id", "doc_id")
    named = tables.settle(roots.join(ids, "id").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    joined = roots.join(small(named), "root").select("id", "component_id")
    out = settle(ids.join(made.select("id", "n"), "id").join(joined, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    tables.drop()
    return out
