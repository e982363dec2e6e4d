"""A Merkle manifest of a table: each row's leaf, root and proof, and whether a copy of the row is still what it was.

Trees have runs of WIDTH consecutive nodes under each parent, one tree a group; the trees' roots, in the groups' order, are the leaves of
one more tree. Large blocks of consecutive leaves, BLOCK of them, are reduced by tasks of their own, and their roots again, until
at most TOP nodes are left in all; the driver builds what is above and each of those nodes' path to the root. On the way down the paths go to the
executors (broadcast: TOP at most), which put each block's own part before them and at last fold every row's leaf upwards.
Nothing that a task or the driver holds grows with the table: BLOCK nodes, or TOP.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, fresh, settle, small

WIDTH, LEVELS = 8, 4
BLOCK = WIDTH**LEVELS
#: Nodes that the driver builds the upper tree of; rows of a few hashes a level each.
TOP = 4096
#: Hashes before and after a node among its run, level by level.
PATH = T.ArrayType(T.StructType([T.StructField("before", T.StringType(), False), T.StructField("after", T.StringType(), False)]), False)
PATH_ARROW = pa.list_(pa.struct([pa.field("before", pa.string(), False), pa.field("after", pa.string(), False)]))
Path = list[tuple[str, str]]
#: Of nodes by tree and place: the path to the root of all, the tree's root, the root. In the driver's hand, or a table of those columns.
Upper = Broadcast | DataFrame


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The hash of a row's values: `-` for null, else their length in bytes, `:` and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def climb(nodes: list[str], size: int, levels: int | None = None) -> tuple[str, list[Path]]:
    """The root of consecutive nodes of a tree of ``size`` nodes (the nodes are all of them, or a block) and each one's path to it.

    levels: how many at most; a node that is alone in its block has a parent of its own while others of its tree are left.
    """
    paths: list[Path] = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while size > 1 and levels != 0:
        above, below = [], []
        for a in range(0, len(nodes), WIDTH):
            part = nodes[a : a + WIDTH]
            for i in range(len(part)):
                step = ("".join(part[:i]), "".join(part[i + 1 :]))
                for x in under[a + i]:
                    paths[x].append(step)
            above.append(digest("".join(part)))
            below.append([x for y in under[a : a + WIDTH] for x in y])
        nodes, under, size = above, below, -(-size // WIDTH)
        levels = levels and levels - 1
    return nodes[0], paths


def fold(node: str, path: Path) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def ranked(df: DataFrame, tree: str, order: list[str], tables: Tables) -> DataFrame:
    """df with ``pos``, a row's place in its tree by the order (from 0), and ``size``, the tree's number of rows.

    Rows are sorted by range, so that a tree may be most of the table; a place is that in the task's part and what is before it.
    """
    part, place = fresh(df, "part"), fresh(df, "place")
    rows = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    rows = tables.settle(rows.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)))
    runs = rows.groupBy(tree, part).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    before = Window.partitionBy(tree).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = tables.settle(runs.select(tree, part, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(tree)).alias("size")))
    return rows.join(small(runs), [tree, part]).withColumn("pos", F.col(place) - F.col("first") + F.col("ahead")).drop(part, place, "first", "ahead")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of rows sorted by (tree, block)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        trees, numbers = batch.column("tree").to_pylist(), batch.column("block").to_numpy()
        cuts = [0, *(i for i in range(1, len(trees)) if trees[i] != trees[i - 1] or numbers[i] != numbers[i - 1]), len(trees)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and (trees[a], numbers[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = trees[a], numbers[a]
    if held:
        yield pa.Table.from_batches(held)


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows by (tree, block, pos), a block in one task."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _placed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {WIDTH**levels}"))


def _parents(placed: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, size, node): what ``levels`` levels make of each block of nodes."""
    block = WIDTH**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            size = t.column("size")[0].as_py()
            node, _ = climb(t.column("node").to_pylist(), size, levels)
            row = (t.column("tree")[0].as_py(), pa.string()), (t.column("block")[0].as_py(), pa.int64()), (-(-size // block), pa.int64()), (node, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in row], names=["tree", "pos", "size", "node"])

    return _by_block(placed.select("tree", "block", "pos", "size", "node")).mapInArrow(run, "tree string, pos long, size long, node string")


def _fall(placed: DataFrame, upper: Upper, levels: int, schema: T.StructType, finish: Callable[[pa.Table, list[Path], str, str], pa.RecordBatch]) -> DataFrame:
    """What ``finish`` makes of each block of nodes, their paths, the tree's root and the root of all.

    A table of upper paths sends each block's as one more row, before the others.
    """
    sent = upper if isinstance(upper, Broadcast) else None
    if sent is None:
        placed = placed.unionByName(upper.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            if sent is None:
                path, subroot, root = [(x["before"], x["after"]) for x in t.column("path")[0].as_py()], t.column("subroot")[0].as_py(), t.column("root")[0].as_py()
                t = t.slice(1)
            else:
                path, subroot, root = sent.value[t.column("tree")[0].as_py(), t.column("block")[0].as_py()]
            _, own = climb(t.column("node").to_pylist(), t.column("size")[0].as_py(), levels)
            yield finish(t, [x + path for x in own], subroot, root)

    return _by_block(placed).mapInArrow(run, schema)


def _upper(nodes: DataFrame, tables: Tables, top: int, levels: int) -> Upper:
    """The paths of nodes(tree, pos, size, node) to the root of all trees."""
    if nodes.limit(top + 1).count() <= top:
        trees: dict[str, list[str]] = {}
        for r in sorted(nodes.collect(), key=lambda r: (r.tree, r.pos)):
            trees.setdefault(r.tree, []).append(r.node)
        grown = [climb(x, len(x)) for x in trees.values()]
        root, above = climb([x for x, _ in grown], len(grown)) if grown else ("", [])
        paths = {(t, i): (own + up, sub, root) for t, (sub, each), up in zip(trees, grown, above, strict=True) for i, own in enumerate(each)}
        return nodes.sparkSession.sparkContext.broadcast(paths)
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("path", PATH), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

    def paths(t: pa.Table, whole: list[Path], subroot: str, root: str) -> pa.RecordBatch:
        path = pa.array([[{"before": b, "after": a} for b, a in x] for x in whole], PATH_ARROW)
        return pa.RecordBatch.from_arrays([t.column("tree").combine_chunks(), t.column("pos").combine_chunks(), path, pa.array([subroot] * len(t)), pa.array([root] * len(t))], names=schema.fieldNames())

    if nodes.where("size > 1").limit(1).count():
        placed = _placed(nodes, levels)
        upper = _upper(tables.settle(_parents(placed, levels)), tables, top, levels)
        return tables.settle(_fall(placed, upper, levels, schema, paths))
    # Only trees' roots are left: they are the leaves of one tree.
    roots = ranked(nodes.select(F.lit("").alias("over"), "tree", "node"), "over", ["tree"], tables)
    placed = _placed(tables.settle(roots.select(F.col("over").alias("tree"), "pos", "size", "node", F.col("tree").alias("own"))), levels)
    upper = _upper(tables.settle(_parents(placed, levels)), tables, top, levels)

    def subroots(t: pa.Table, whole: list[Path], subroot: str, root: str) -> pa.RecordBatch:
        made = paths(t, whole, subroot, root)
        columns = [t.column("own").combine_chunks(), pa.array([0] * len(t), pa.int64()), made.column("path"), t.column("node").combine_chunks(), made.column("root")]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return tables.settle(_fall(placed, upper, levels, schema, subroots))


def manifest(df: DataFrame, columns: list[str], tree: str = "lang", order: str = "doc_id", copy: dict[str, Column] | None = None, top: int = TOP, levels: int = LEVELS) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of df.

    columns: what a leaf is the hash of. tree: the column whose values each have a tree; trees are ordered by it, null first, as bytes. order:
    a tree's leaves ascend by it, null first, rows of one value by their leaves; repeated rows have places of their own. copy: expressions for
    columns of a received copy, whose leaf is folded to folded_root along the proof; verified says that it is the root.
    proof_sha256 is of the proof's hashes, from the row's run up. An empty table gives an empty table, and a lone row is its own root; other
    columns, whatever their names, are left out. Leaves are written once, as their order is sampled and then used; tables on the way go when
    the application ends or before.
    """
    tables = Tables(df.sparkSession)
    col = lambda x: F.col(f"`{x}`")
    group = F.coalesce(F.concat(F.lit("="), col(tree).cast("string")), F.lit(""))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024))  # so that many like rows are more than one range
    rows = df.select(col(order).alias("id"), group.alias("tree"), leaf(*(col(x) for x in columns)).alias("node"), leaf(*((copy or {}).get(x, col(x)) for x in columns)).alias("seen"), salt.alias("salt"))
    rows = ranked(tables.settle(rows), "tree", ["id", "node", "salt"], tables).select("tree", "pos", "size", "id", "node", "seen")
    rows = _placed(tables.settle(rows), levels)
    upper = _upper(tables.settle(_parents(rows, levels)), tables, top, levels)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([T.StructField("id", df.schema[order].dataType), *(T.StructField(x, T.StringType()) for x in names), T.StructField("verified", T.BooleanType())])

    def finish(t: pa.Table, whole: list[Path], subroot: str, root: str) -> pa.RecordBatch:
        proofs = [digest("".join([b + a for b, a in path])) for path in whole]
        folded = [fold(x, path) for x, path in zip(t.column("seen").to_pylist(), whole, strict=True)]
        text = [t.column("node").combine_chunks(), *(pa.array(x, pa.string()) for x in ([subroot] * len(t), [root] * len(t), proofs, folded))]
        return pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), *text, pa.array([x == root for x in folded], pa.bool_())], names=schema.fieldNames())

    out = settle(_fall(rows, upper, levels, schema, finish))
    tables.drop()
    return out.withColumnRenamed("id", order)
