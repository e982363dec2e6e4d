"""Rows that share keys, joined where they are alike: what the similarity joins over word shingles have in common.

Sets of shingle hashes are sorted arrays of long. Pairs are (a, b), of ids; where many have one row in common, that is b.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Tables, small

#: Rows that one task holds against one row; more are dealt to several.
HUB_ROWS = 1000
#: Rows of a group that are compared with one another, or with those of another block, in one place.
BLOCK_ROWS = 2000
#: Sizes of a band are less than this much apart, or than the similarity allows if that is more.
BAND = Fraction(5, 4)
Check = Callable[[DataFrame], DataFrame]


def mix(h: np.ndarray, j: int) -> np.ndarray:
    """Independent hashes from one; the first is the hash itself."""
    if not j:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15 * j & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def bands(similarity: Fraction, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands up to beyond ``most``; how many parts, and how many light ones to leave out, a pair's later band has.

    Sets smaller than the first size are alike only if they are equal. Sets alike are in one band or in neighbouring ones. They differ
    in d elements at most, so of d + 1 + 2 * x parts they have 1 + 2 * x in common at least, one of them even if each set leaves out
    its x lightest.
    """
    step = max(BAND, 1 / similarity)
    first = [-(-similarity // (1 - similarity))]
    while first[-1] <= most / similarity or len(first) < 3:
        first.append(max(first[-1] + 1, int(first[-1] * step)))
    parts, light = [], []
    for low, high in zip(first, first[1:], strict=False):
        d = int(2 * (high - 1) * (1 - similarity) / (1 + similarity))
        x = int(4 * (d + 1) * exp(-float(low * similarity) / (d + 1))) + (d > 5)
        parts.append(d + 1 + 2 * x)
        light.append(x)
    return np.array(first, np.int64), np.array(parts, np.int64), np.array(light, np.int64)


def part_keys(hashes: list[np.ndarray], similarity: Fraction) -> list[np.ndarray]:
    """Keys of sets of distinct hashes: two different sets with this Jaccard similarity or more share one.

    A set's elements are dealt by hash into parts, whose number follows from the sizes' band; each part's key is of all its elements. A
    set takes its own band's parts, and the next one's if a set alike may be there.
    """
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    first, parts, light = bands(similarity, int(n.max(initial=0)))
    own = np.searchsorted(first, n, "right") - 1
    up = np.array([int(x / similarity) for x in n.tolist()], np.int64)
    both = (own >= 0) & (up >= first[np.minimum(own + 1, len(first) - 1)])
    rows = np.concatenate((np.flatnonzero(own >= 0), np.flatnonzero(both)))
    if not len(rows):
        return [np.zeros(0, np.int64)] * len(hashes)
    band = np.concatenate((own[own >= 0], own[both] + 1))
    count, size = parts[band], n[rows]
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    flat = np.concatenate([hashes[i] for i in rows])
    at = np.repeat(np.arange(len(rows)), size)
    slot = begin[at] + ((mix(flat, 5) >> np.uint64(32)) * count[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(int(count.sum()), np.uint64)
    np.add.at(sums, slot, mix(flat, 6))
    weight = np.bincount(slot, minlength=len(sums))
    of = np.repeat(np.arange(len(rows)), count)
    number = np.arange(len(sums)) - begin[of]
    lightest = np.lexsort((number, weight, of))
    place = np.empty(len(sums), np.int64)
    place[lightest] = number
    kept = place >= light[band][of]
    with np.errstate(over="ignore"):
        keys = mix(sums + (band[of].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64), 7)
    doc, keys = rows[of][kept], keys[kept].view(np.int64)
    order = np.argsort(doc, kind="stable")
    return np.split(keys[order], np.cumsum(np.bincount(doc, minlength=len(hashes)))[:-1])


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of (id, key) whose key others have too. One shuffle; a key's rows pass by one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # the row before, if its key has been seen just once
        before = None
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            if not len(keys):
                continue
            same = np.r_[keys[0] == before, keys[1:] == keys[:-1]]
            twice = same | np.r_[same[1:], False]
            more = [(last[0], last[1])] if same[0] and last else []
            last = None if same[-1] else (int(ids[-1]), int(keys[-1]))
            before = keys[-1]
            out = np.concatenate((np.array([x for x, _ in more], np.int64), ids[twice])), np.concatenate((np.array([k for _, k in more], np.int64), keys[twice]))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["id", "key"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, key long")


def meet(pairs: DataFrame, rows: DataFrame, test: Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """The pairs (a, b) that pass a test of rows(id, n, v): n and v of b, and n and v of all of some a.

    b's rows are dealt by HUB_ROWS, and b itself comes once before each part of them.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(small(parts), "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
    one = rows.withColumnRenamed("id", "b").join(parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "b")
    many = dealt.join(rows.withColumnRenamed("id", "a"), "a")
    columns = ("b", "part", "a", "n", "v")
    both = many.select(*columns).unionByName(one.select("b", "part", F.lit(None).cast("long").alias("a"), "n", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[int, int, np.ndarray] | None = None
        for batch in batches:
            b, a, n, v = (batch.column(x) for x in ("b", "a", "n", "v"))
            heads = np.flatnonzero(a.is_null().to_numpy(zero_copy_only=False)).tolist()
            for i, j in zip([-1, *heads], [*heads, len(a)], strict=True):
                if i >= 0:
                    hub = b[i].as_py(), n[i].as_py(), v[i].values.to_numpy(zero_copy_only=False)
                if j > i + 1:
                    part = slice(i + 1, j)
                    lists = [x.values.to_numpy(zero_copy_only=False) for x in v.slice(i + 1, j - i - 1)]
                    kept = a.slice(i + 1, j - i - 1).filter(pa.array(test(hub[1], hub[2], n.to_numpy()[part], lists)))
                    yield pa.RecordBatch.from_arrays([kept, pa.array([hub[0]] * len(kept), pa.int64())], names=["a", "b"])

    return both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).mapInArrow(run, "a long, b long")


def alike(similarity: Fraction) -> Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]:
    """A test for ``meet``: the Jaccard similarity of sets of hashes."""

    def test(_: int, own: np.ndarray, __: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        own = np.sort(own)
        out = []
        for x in others:
            common = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum()) if len(own) else 0
            out.append(common * similarity.denominator >= similarity.numerator * (len(own) + len(x) - common))
        return np.array(out, bool)

    return test


def join_groups(tables: Tables, shared: DataFrame, same: DataFrame, check: Check, compare: Check) -> DataFrame:
    """(node, root) of rows joined over pairs that are alike.

    shared(id, key, n): rows of groups by key, n the group's size. same(a, b): pairs known to be alike. check: of pairs (a, b), those
    alike. In each group all rows are compared with one, that whose keys most rows share (the source of copies that are not alike
    among themselves): each row first with the one of its groups that is most so, then with the others that this doesn't join it to. Where the
    links so checked don't join all rows of a group, compare gives pairs that may be alike of its rows (key, n, id, root).
    """
    from .simhash import components

    weight = tables.settle(shared.groupBy("id").agg(F.sum("n").alias("w")))
    order = F.struct("w", F.xxhash64("id").alias("h"), "id")
    hubs = tables.settle(shared.join(small(weight), "id").groupBy("key").agg(F.max(order).alias("hub")))
    led = shared.join(small(hubs, BROADCAST_ROWS // 4), "key").select("id", "key", "hub")
    foremost = tables.settle(led.groupBy("id").agg(F.max("hub").alias("hub")).select(F.col("id").alias("a"), F.col("hub.id").alias("b")).where("a <> b"))
    links = tables.settle(check(foremost))
    near = links.select(F.col("a").alias("id"), F.col("b").alias("up"))
    top = tables.settle(near.join(near.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("top")))
    further = tables.settle(led.select(F.col("id").alias("a"), F.col("hub.id").alias("b")).where("a <> b").distinct().join(small(foremost), ["a", "b"], "left_anti"))
    for x, to in (("a", "p"), ("b", "q")):
        further = further.join(small(top.select(F.col("id").alias(f"of_{x}"), F.col("top").alias(to))), F.col(x) == F.col(f"of_{x}"), "left").withColumn(to, F.coalesce(to, x))
    further = tables.settle(further.where("p <> q").select("a", "b"))
    done = tables.settle(ordered(foremost.unionByName(further)))
    links = tables.settle(same.unionByName(links).unionByName(check(further)))
    roots = components(links)
    # The rest of the groups that these links don't join.
    placed = tables.settle(shared.join(small(roots.withColumnRenamed("node", "id")), "id", "left").select("id", "key", "n", F.coalesce("root", "id").alias("root")))
    live = tables.settle(placed.where("n > 2").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"))
    if live.limit(1).count():
        more = tables.settle(ordered(compare(placed.join(small(live), "key"))).join(done, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            roots = components(links.unionByName(check(more)))
    return roots


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_blocks(rest: DataFrame, pairs: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``pairs`` makes of groups rest(key, n, id, ...): of a whole one, or of each two blocks of about BLOCK_ROWS of its rows.

    pairs is given the rows and the places of the two blocks' (the same, if it is one).
    """
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rest = rest.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n")

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        own, i, j = (table.column(x).to_numpy() for x in ("own", "i", "j"))
        left = np.flatnonzero(own == i[0])
        yield from pairs(table, left, left if i[0] == j[0] else np.flatnonzero(own == j[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("key", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[a]) != last:
                    yield from one(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if held:
            yield from one(held)

    return rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")
