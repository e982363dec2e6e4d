"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Two uses share the parts. ``link`` takes one 64-bit fingerprint per document and finds all pairs of fingerprints
at two or fewer differing bits: fingerprints are cut in two halves; each probes a table of exact halves with the ball of
radius one around its own, and complete distances are verified. ``near_copies`` finds documents whose word shingles are 0.8
alike: at that similarity about 15 % of the bits differ, so longer fingerprints with many segments are used, the balls
are over the bits of least margin, and after the distance the similarity itself is verified. There each segment's table is split
by the least shingle hash under an order of the segment's own, which texts 0.8 alike share four times of five and unlike texts
hardly ever: without that, rows that share a segment by chance grow with the square of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import Tables, chunks, fresh, others, settle, small
from .groups import alike, in_blocks, join_groups, meet, mix, part_keys, shared_keys

SEED = 42
#: More fingerprints than this with one half: their links are found by enumerating whole fingerprints instead.
FULL_HALF = 500


def shingles(text: bytes, size: int) -> list[bytes]:
    """Shingles of lower-cased (A-Z) words, repeats included; the whole sequence if it is shorter, none if empty."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1]
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


#: The bits of each byte, the lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def hashes_of(text: bytes, size: int, distinct: bool = False) -> np.ndarray:
    s = shingles(text, size)
    out = np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s))
    return np.unique(out) if distinct else out


def bit_counts(hashes: list[np.ndarray], longs: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each list of shingle hashes how many have each of 64 * longs bits set, and their number.

    The bytes of all hashes are counted by list and value, and bits follow from the counts.
    """
    n = np.array(list(map(len, hashes)), np.int64)
    out = np.zeros((len(hashes), 64 * longs), np.int64)
    rows = max(1, len(hashes))
    at = np.repeat(np.arange(len(hashes), dtype=np.int64) << 8, n)
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    for j in range(longs):
        octets = mix(flat, j).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            seen = np.bincount(at + octets[:, k], minlength=rows << 8).reshape(rows, 256)
            out[:, 64 * j + 8 * k : 64 * j + 8 * k + 8] = (seen @ BITS)[: len(hashes)]
    return out, n


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", size: int = 3) -> DataFrame:
    """df without its text column and with a 64-bit fingerprint (long), which replaces a column of that name in any case.

    Null and empty texts have fingerprint zero. Rows are independent; an empty table gives an empty table.
    """
    source = fresh(df, "text")
    kept = others(df, (name, text))
    schema = StructType([*kept, StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, source):
                counts, n = bit_counts([hashes_of(x, size) for x in texts])
                bits = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(a, b - a) for f in kept), pa.array(bits.view("<i8").ravel(), pa.int64())], names=schema.fieldNames())

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)


def _flips(bits: int, radius: int) -> list[int]:
    """All masks of so many low bits with at most ``radius`` (0 to 2) set."""
    ones = [1 << i for i in range(bits)]
    out = [0]
    if radius:
        out += ones
    if radius > 1:
        out += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    return out


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, tables: Tables, distance: int = 2) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) at ``distance`` (2 at most) or fewer bits; a pair may come twice.

    prints: distinct, cheap to read. If two fingerprints differ in two bits, one half differs in one at most. A half
    that more than FULL_HALF fingerprints share is not joined on: whole fingerprints are enumerated from each that
    probes it, 529 at most, so the candidates of a fingerprint don't grow with the group. What is exploded is never broadcast: Spark takes it
    for as large as the file that it was made of.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distances of 0 to 2 bits")
    low = 0xFFFFFFFF
    halves = [(0, F.col("fp").bitwiseAND(F.lit(low))), (1, F.shiftrightunsigned("fp", 32))]
    exact = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("half"), v.alias("value")) for i, v in halves))).alias("x")).select("fp", "x.half", "x.value")
    reach = distance // 2
    masks = F.array(*(F.lit(m).cast("long") for m in _flips(32, reach)))
    probe = exact.select("half", F.col("value").alias("own"), F.col("fp").alias("a"), F.explode(masks).alias("mask")).select("half", "own", "a", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    full = tables.settle(exact.groupBy("half", "value").count().where(F.col("count") > FULL_HALF).select("half", "value"))
    crowded = full.limit(1).count() > 0
    table = exact.withColumnRenamed("fp", "b")
    if crowded:
        table = table.join(small(full), ["half", "value"], "left_anti")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") < F.col("b"))
    out = probe.drop("own").hint("merge").join(table.hint("merge"), ["half", "value"]).where(near).select("a", "b")
    if crowded:
        hit = probe.join(small(full), ["half", "value"]).withColumn("used", F.bit_count(F.col("own").bitwiseXOR(F.col("value"))))
        for i in range(2):
            shift = 32 * (1 - i)  # the other half's place
            for used in range(reach + 1):
                other = F.array(*(F.lit(_long(m << shift)).cast("long") for m in _flips(32, distance - used)))
                moved = F.shiftleft(F.col("own").bitwiseXOR(F.col("value")), 32 * i)
                some = hit.where((F.col("half") == i) & (F.col("used") == used)).select("a", F.explode(other).alias("mask"), moved.alias("moved"))
                some = some.select("a", F.col("a").bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("mask")).alias("fp")).where("a < fp")
                out = out.unionByName(some.join(prints, "fp", "left_semi").select("a", F.col("fp").alias("b")))
    return out


#: Edges (16 bytes each) that one task joins.
EDGES_IN_A_TASK = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges, by a forest of nodes with path halving."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = find(a), find(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): one root for each connected component.

    Each round every node points at the one of least hash among itself and its neighbours, and edges are redrawn between
    what their ends point at; the nodes left fall by a constant factor, whatever the shape. Once EDGES_IN_A_TASK or fewer are left, one task
    joins them. Edges and pointers of a round are tables in the shared folder. No edges give no rows; loops and repeated edges do no harm;
    edges with null are ignored.
    """
    tables = Tables(edges.sparkSession)
    edges = tables.settle(edges.where("a is not null and b is not null").select("a", "b").distinct())
    rounds: list[DataFrame] = []
    while n := edges.limit(EDGES_IN_A_TASK + 1).count():
        if n <= EDGES_IN_A_TASK:
            rounds.append(tables.settle(edges.coalesce(1).mapInArrow(_joined, "node long, root long")))
            break
        salt = F.lit(len(rounds))
        rank = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        points = tables.settle(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("root")))
        rounds.append(points)
        one = edges.join(points, edges.a == points.node).select(F.col("root").alias("x"), "b")
        two = one.join(points, one.b == points.node).select("x", F.col("root").alias("y")).where("x <> y")
        edges = tables.settle(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    out = rounds[0] if rounds else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for points in rounds[1:]:
        step = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = settle(out)
    tables.drop()
    return out


def link(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id: the least doc_id reached over links, its own included.

    One row per row of df; repeated rows give repeated rows. A null doc_id has a fingerprint and links like any other; it
    is a component's id only if all of the component's are null. Null and empty texts have fingerprint zero, which links.
    """
    tables = Tables(df.sparkSession)
    own = settle(fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))))
    prints = tables.settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(prints.select("fp"), tables, distance)).withColumnRenamed("node", "fp")
    placed = tables.settle(prints.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(placed.join(least, "root").select("fp", "component_id"))
    tables.drop()
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Longs of the fingerprint that segments are cut from, bits of a segment and those of least margin that balls flip; longs of the
#: fingerprint whose complete distances are verified.
LONGS, SEGMENT_BITS, LOOSE_BITS, WHOLE_LONGS = 6, 20, 4, 32
#: Complete fingerprints (256 bytes each) up to this number are broadcast.
BROADCAST_PRINTS = 20_000
#: Sets of fewer shingles than this have many tied bits, and a shingle more or less changes too many: they are found by parts of the sets as
#: well, and their complete distances have no limit.
SHORT = 64


def segment_keys(counts: np.ndarray, n: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """The keys of each fingerprint's balls: a segment's value, and that with one of its bits of least margin flipped,
    each within the part of the segment's table that the least shingle hash, under the segment's order, names."""
    bits = counts * 2 > n[:, None]
    margin = np.abs(counts * 2 - n[:, None])
    segments = bits.shape[1] // SEGMENT_BITS
    part = bits[:, : segments * SEGMENT_BITS].reshape(len(bits), segments, SEGMENT_BITS)
    value = (part.astype(np.int64) << np.arange(SEGMENT_BITS)).sum(2)
    loose = np.argsort(margin[:, : segments * SEGMENT_BITS].reshape(part.shape), axis=2, kind="stable")[:, :, :LOOSE_BITS]
    balls = np.concatenate((value[:, :, None], value[:, :, None] ^ (1 << loose)), axis=2).astype(np.uint64)
    least = np.zeros((len(bits), segments), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat, starts = np.concatenate(hashes), np.concatenate(([0], np.cumsum(n[some])[:-1]))
        for i in range(segments):
            order = np.uint64(xxhash.xxh64_intdigest(b"order", i))
            least[some, i] = np.minimum.reduceat(flat ^ order, starts) ^ order
    keys = mix(balls | (np.arange(segments, dtype=np.uint64) << np.uint64(32))[None, :, None], 1) ^ mix(least, 2)[:, :, None]
    return mix(keys, 3).reshape(len(bits), -1).view(np.int64)


def near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, root): for rows of df alike in their word shingles (Jaccard >= similarity), joined over such pairs.

    key: a unique column without nulls of type long. Rows without a partner aren't returned. Null texts are empty; texts without words
    are alike. An empty table gives an empty table. Rows of one set of shingles (by 128 bits) are links at once; one of them goes on.
    Candidates share a segment key of their fingerprints, or if they are short a part of their sets. Groups of one key are joined as
    ``groups.join_groups`` says, so that every pair that shares a key is joined or compared: by the complete distance of longer
    fingerprints, then by the similarity itself.
    """
    tables = Tables(df.sparkSession)
    exact = Fraction(similarity).limit_denominator(1000)
    base = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, "t"):
                hashes = [hashes_of(x, size, distinct=True) for x in texts]  # the similarity is of sets
                keys = list(segment_keys(*bit_counts(hashes, LONGS), hashes))
                short = [i for i, h in enumerate(hashes) if len(h) * similarity < SHORT]
                for i, more in zip(short, part_keys([hashes[i] for i in short], exact), strict=True):
                    keys[i] = np.concatenate((keys[i], more))
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h) for h in hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["id", "x", "y", "keys"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, "t", 500_000):
                hashes = [hashes_of(x, size, distinct=True) for x in texts]
                counts, n = bit_counts(hashes, WHOLE_LONGS)
                bits = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<i8")
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (bits, [h.view(np.int64) for h in hashes])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), *lists], names=["id", "n", "v", "s"])

    made = tables.settle(base.mapInArrow(segments, "id long, x long, y long, keys array<long>"))
    sets = tables.settle(made.groupBy("x", "y").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    same = tables.settle(made.select("id", "x", "y").join(small(sets), ["x", "y"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    keyed = made.join(small(same.select(F.col("b").alias("id"))), "id", "left_anti").select("id", F.explode("keys").alias("key"))
    shared = tables.settle(shared_keys(keyed))
    shared = tables.settle(shared.join(small(shared.groupBy("key").agg(F.count("*").alias("n"))), "key"))
    rows = tables.settle(base.join(small(shared.select("id").distinct()), "id", "left_semi").mapInArrow(prints, "id long, n long, v array<long>, s array<long>"))
    limit = distance_limit(similarity)

    def check(pairs: DataFrame) -> DataFrame:
        near = tables.settle(meet(pairs, rows.select("id", "n", "v"), _near(limit)))
        return tables.settle(meet(near, rows.select("id", "n", F.col("s").alias("v")), alike(exact)))

    def compare(rest: DataFrame) -> DataFrame:
        own = small(rows.select("id", F.col("n").alias("size"), "v"), BROADCAST_PRINTS)
        return in_blocks(rest.join(own, "id"), _compare(limit))

    roots = join_groups(tables, shared, same, check, compare)
    tables.drop()
    return roots.select(F.col("node").alias(key), "root")


def distance_limit(similarity: float) -> int:
    """Differing bits of the complete fingerprints of sets of SHORT shingles or more: as expected at the similarity and three standard
    deviations more."""
    bits = 64 * WHOLE_LONGS
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + 3 * np.sqrt(bits * share * (1 - share)))


def _near(limit: int) -> Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]:
    """A test for ``groups.meet``: complete fingerprints as near as the similarity asks, if both sets are large enough to tell."""

    def test(n: int, own: np.ndarray, sizes: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        far = np.bitwise_count(np.stack(others).view(np.uint64) ^ own.view(np.uint64)).sum(1, dtype=np.int64)
        return (far <= limit) | (np.minimum(sizes, n) < SHORT)

    return test


def _compare(limit: int) -> Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]:
    """Of a group's rows, the pairs that are near and of different roots."""

    def pairs(table: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, roots, n = (table.column(x).to_numpy() for x in ("id", "root", "size"))
        fp = table.column("v").combine_chunks().values.to_numpy().view(np.uint64).reshape(-1, WHOLE_LONGS)
        once = left is right
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            far = sum(np.bitwise_count(fp[some, k][:, None] ^ fp[right, k][None, :]).astype(np.int16) for k in range(WHOLE_LONGS))
            near = (far <= limit) | (np.minimum(n[some][:, None], n[right][None, :]) < SHORT)
            x, y = np.nonzero(near & (roots[some][:, None] != roots[right][None, :]) & ((ids[some][:, None] < ids[right][None, :]) | (not once)))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some[x]]), pa.array(ids[right[y]])], names=["a", "b"])

    return pairs
