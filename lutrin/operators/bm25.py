"""BM25 (Okapi, with a floor under negative idf) over a corpus, for a batch of queries, from a stored index that is added to.

The index is a log of segments under versions (``sources.snapshots``). A segment has its rows in ranges, and each term's postings of a range
as one block with the greatest tf and the least length in it. From these alone follows the most that any row of a range can score,
whatever the corpus's averages are by then, so ranges that can't reach a query's k-th score are never opened. A posting is a row's place in its range and a count. Rows that are removed or replaced
stay in their blocks and are named in a list of the dead, until segments are merged; document frequencies, the number of rows and
their length are those of the living, as a new index of them would have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import PUNCTUATION, normalize
from ..sources import io, snapshots
from .sizes import small

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms up to this number are asked for by name, which the files' statistics answer; more are joined.
NAMED = 10
#: A range has so many rows at most, and no further row once it has so many tokens.
RANGE_ROWS, RANGE_TOKENS = 128, 200_000
#: Terms of questions up to this number are sent to all tasks; those of more are joined with the postings.
SENT = 100_000
#: Ranges up to this number are broadcast with the queries that ask for them.
ROWS_ASKED = 2_000
#: Questions whose scores of a range's rows are in memory together, and numbers that a task holds to know what each question has by then.
AT_ONCE, HELD = 256, 4_000_000
#: What is taken off a k-th score before bounds are held against it: scores are rounded to 6 decimals.
SLACK = 2e-6


@dataclass
class Index:
    """blocks(term, r, n, max_tf, min_dl, rows, tfs), ranges(r, ids, dls), dead(r, row, chunk_id) or None, vocabulary(term, df, idf),
    stats(n, avgdl, avg_idf, total).

    A block is of one term in one range r, whose rows it names by their places in ids and dls. Where a row has gone for good its id is null.
    """

    blocks: DataFrame
    ranges: DataFrame
    dead: DataFrame | None
    vocabulary: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, dl) of the living."""
        return _opened(self.blocks, self).select("chunk_id", "term", "tf", "dl")


def _opened(blocks: DataFrame, index: Index) -> DataFrame:
    """The living postings of blocks: their columns with tf, row, chunk_id and dl in place of the arrays."""
    kept = [x for x in blocks.columns if x not in ("rows", "tfs", "n", "max_tf", "min_dl")]
    each = blocks.join(index.ranges, "r").select(*kept, "ids", "dls", F.explode(F.arrays_zip("rows", "tfs")).alias("x"))
    row = F.col("x.rows").cast("int")
    each = each.select(*kept, row.alias("row"), F.get("ids", row).alias("chunk_id"), F.col("x.tfs").alias("tf"), F.get("dls", row).alias("dl"))
    return each if index.dead is None else each.join(small(index.dead.select("r", "row")), ["r", "row"], "left_anti")


def read(spark: SparkSession, path: str, version: int | None = None) -> Index:
    held = snapshots.load(spark, path, version)
    if held is None:
        raise ValueError(f"no index at {path}")
    every = lambda names: reduce(DataFrame.union, [spark.read.parquet(f"{path}/{x}") for x in names])
    return Index(every(held["blocks"]), every(held["ranges"]), every(held["dead"]) if held["dead"] else None, spark.read.parquet(f"{path}/{held['vocabulary']}"), spark.read.parquet(f"{path}/{held['stats']}"))


def _words(text: bytes | None) -> list[str]:
    """The terms of a lower-cased text, as ``normalize`` has them."""
    return (text or b"").translate(None, PUNCTUATION.encode()).decode(errors="replace").split()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[list[str]]]]:
    """A task's rows and their terms, cut where a range ends."""
    number = 0
    for batch in batches:
        texts, a, words, tokens = batch.column("text").cast(pa.binary()), 0, [], 0
        for i in range(batch.num_rows):
            words.append(_words(texts[i].as_py()))
            tokens += len(words[-1])
            if len(words) == RANGE_ROWS or tokens >= RANGE_TOKENS or i + 1 == batch.num_rows:
                yield number, batch.slice(a, i + 1 - a), words
                number, a, words, tokens = number + 1, i + 1, [], 0


def _blocks(corpus: DataFrame, segment: int, key: str, text: str) -> DataFrame:
    """The blocks of a segment and, with null terms, its ranges, one after another: rows are tokenised once and not moved. Null text has no
    terms, and still counts as a row."""
    kind, whole = corpus.schema[key].dataType, IntegerType()
    schema = StructType().add("term", StringType()).add("r", LongType()).add("n", whole).add("max_tf", whole).add("min_dl", whole).add("rows", ArrayType(ByteType())).add("tfs", ArrayType(whole)).add("ids", ArrayType(kind)).add("dls", ArrayType(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, words in _ranges(batches):
            r = segment << 48 | rows.column("task")[0].as_py() << 24 | number
            ids = rows.column("chunk_id")
            lengths = np.array(list(map(len, words)), np.int64)
            coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
            row = pairs % len(lengths)
            starts = np.flatnonzero(np.r_[True, np.diff(pairs // len(lengths)) > 0][: len(pairs)])
            ends = np.append(starts, len(row))
            number_of = lambda x: pa.array(x, pa.int32())
            # The range itself comes first.
            terms = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.cast(pa.string())])
            least = np.minimum.reduceat(lengths[row], starts) if len(starts) else starts
            most = np.maximum.reduceat(tf, starts) if len(starts) else starts
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), x)
            whole = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(ends), len(lengths))), pa.int32()), x, mask=pa.array(np.arange(len(ends)) > 0))
            numbers = [number_of(np.append(first, x)) for first, x in ((len(lengths), np.diff(ends)), (0, most), (0, least))]
            columns = [terms, pa.array([r] * len(ends), pa.int64()), *numbers, listed(pa.array(row, pa.int8())), listed(number_of(tf)), whole(ids), whole(number_of(lengths))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    lowered = corpus.select(F.spark_partition_id().alias("task"), F.col(key).alias("chunk_id"), F.lower(F.col(text)).alias("text"))
    return lowered.mapInArrow(run, schema)


class _Scratch:
    """Tables that are needed on the way to others, and go at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(io.temporary(self.spark))
        df.write.mode("overwrite").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __enter__(self) -> _Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            io.remove(self.spark, path)


def _by_term(blocks: DataFrame, path: str) -> str:
    """Store blocks by term, a term that most ranges have in several files."""
    name = snapshots.part("blocks")
    blocks.select("term", "r", "n", "max_tf", "min_dl", "rows", "tfs").repartitionByRange("term", "r").sortWithinPartitions("term", "r").write.parquet(f"{path}/{name}")
    return name


def _stored(corpus: DataFrame, path: str, segment: int, key: str, text: str) -> tuple[str, str]:
    """The names of a new segment's blocks and ranges. They are made once, though sorting reads them twice."""
    spark, ranges = corpus.sparkSession, snapshots.part("ranges")
    with _Scratch(spark) as scratch:
        made = scratch.keep(_blocks(corpus, segment, key, text))
        made.where("term is null").select("r", "ids", "dls").write.parquet(f"{path}/{ranges}")
        return _by_term(made.where("term is not null"), path), ranges


def _counted(spark: SparkSession, path: str, changes: list[DataFrame]) -> dict:
    """Store the vocabulary and the statistics of changes(term, df, dl); df and dl of the null term are of rows and their lengths."""
    counts = reduce(DataFrame.unionByName, changes).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df > 0")
    scratch = _Scratch(spark)
    counts = scratch.keep(counts)
    size = counts.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.sum("dl").alias("dl"))
    raw = counts.where("term is not null").join(F.broadcast(size.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf0"))
    stats, vocabulary = snapshots.part("stats"), snapshots.part("vocabulary")
    size.join(F.broadcast(raw.agg(F.avg("idf0").alias("avg_idf")))).select("n", (F.col("dl") / F.col("n")).alias("avgdl"), "avg_idf", F.col("dl").alias("total")).write.parquet(f"{path}/{stats}")
    mean = spark.read.parquet(f"{path}/{stats}").select("avg_idf")
    floored = F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(EPSILON * F.col("avg_idf"))
    raw.join(F.broadcast(mean)).select("term", "df", floored.alias("idf")).write.parquet(f"{path}/{vocabulary}")
    scratch.__exit__()
    return {"vocabulary": vocabulary, "stats": stats}


def _frequencies(spark: SparkSession, path: str, blocks: str, ranges: str) -> list[DataFrame]:
    """What a segment adds to the counts."""
    length = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = spark.read.parquet(f"{path}/{ranges}").select(F.lit(None).cast("string").alias("term"), F.size("ids").cast("long").alias("df"), length.alias("dl"))
    return [spark.read.parquet(f"{path}/{blocks}").select("term", F.col("n").cast("long").alias("df"), F.lit(0).cast("long").alias("dl")), rows]


def update(spark: SparkSession, path: str, corpus: DataFrame | None = None, removed: DataFrame | None = None, key: str = "chunk_id", text: str = "document", stream: str | None = None, batch: int | None = None) -> Index:
    """Add the rows of corpus to the index at ``path`` (a new one, if there is none), in place of rows of their ids, and remove those of
    removed(chunk_id); what is left is read.

    It costs what the change has, one look at which ranges the changed ids are in, and one pass over the vocabulary. stream, batch: as with
    ``collection.upsert``.
    """
    held = snapshots.load(spark, path) or {"version": 0, "segment": 0, "blocks": [], "ranges": [], "dead": [], "streams": {}}
    if stream is not None and held["streams"].get(stream, -1) >= batch:
        return read(spark, path)
    content = held | {"streams": held["streams"] | ({stream: batch} if stream is not None else {})}
    changes = []
    if held["blocks"]:
        old = read(spark, path)
        rows = old.stats.select(F.lit(None).cast("string").alias("term"), F.col("n").alias("df"), F.col("total").alias("dl"))
        changes += [old.vocabulary.select("term", "df", F.lit(0).cast("long").alias("dl")).unionByName(rows)]
        ids = [x for x in (corpus.select(F.col(key).alias("chunk_id")) if corpus is not None else None, removed.select("chunk_id") if removed is not None else None) if x is not None]
        if ids:
            places = old.ranges.select("r", "dls", F.posexplode("ids").alias("row", "chunk_id")).where("chunk_id is not null").select("r", "row", "chunk_id", F.get("dls", F.col("row")).alias("dl"))
            gone = places.join(small(reduce(DataFrame.union, ids).distinct()), "chunk_id", "left_semi").select("r", "row", "chunk_id", "dl")
            gone = gone if old.dead is None else gone.join(small(old.dead), ["r", "row"], "left_anti")
            name = snapshots.part("dead")
            gone.write.parquet(f"{path}/{name}")
            gone = spark.read.schema(gone.schema).parquet(f"{path}/{name}")
            if gone.limit(1).count():
                content["dead"] = [*held["dead"], name]
                touched = old.blocks.join(small(gone.select("r").distinct()), "r", "left_semi").select("r", "term", F.explode("rows").alias("row"))
                lost = touched.withColumn("row", F.col("row").cast("int")).join(small(gone.select("r", "row")), ["r", "row"], "left_semi")
                changes.append(lost.groupBy("term").agg((-F.count("*")).alias("df")).withColumn("dl", F.lit(0).cast("long")))
                changes.append(gone.select(F.lit(None).cast("string").alias("term"), F.lit(-1).cast("long").alias("df"), (-F.col("dl")).cast("long").alias("dl")))
    if corpus is not None:
        content["segment"] = held["segment"] + 1
        blocks, ranges = _stored(corpus, path, content["segment"], key, text)
        content |= {"blocks": [*held["blocks"], blocks], "ranges": [*held["ranges"], ranges]}
        changes += _frequencies(spark, path, blocks, ranges)
    content |= _counted(spark, path, changes)
    snapshots.commit(spark, path, content, held["version"] + 1)
    return read(spark, path)


def build(corpus: DataFrame, path: str, key: str = "chunk_id", text: str = "document") -> Index:
    """Make the index at ``path`` one of corpus alone, and read it. A row's id should be its own: of rows with one id all count."""
    spark = corpus.sparkSession
    held = snapshots.load(spark, path) or {"version": 0, "segment": 0, "streams": {}}
    segment = held["segment"] + 1
    blocks, ranges = _stored(corpus, path, segment, key, text)
    content = {"segment": segment, "blocks": [blocks], "ranges": [ranges], "dead": [], "streams": held["streams"]} | _counted(spark, path, _frequencies(spark, path, blocks, ranges))
    snapshots.commit(spark, path, content, held["version"] + 1)
    return read(spark, path)


def merge(spark: SparkSession, path: str) -> Index:
    """Make one part of all segments, without the dead: their postings go, and their ids become null, so that the others keep their places."""
    held, old = snapshots.load(spark, path), read(spark, path)
    blocks, ranges, name = old.blocks, old.ranges, snapshots.part("ranges")
    if old.dead is not None:
        lost = small(old.dead.groupBy("r").agg(F.collect_set("row").alias("gone")))
        left = F.filter(F.arrays_zip("rows", "tfs"), lambda x: ~F.array_contains("gone", x["rows"].cast("int")))
        touched = blocks.join(lost, "r", "left").withColumn("x", F.when(F.col("gone").isNotNull(), left).otherwise(F.arrays_zip("rows", "tfs"))).where(F.size("x") > 0)
        blocks = touched.select("term", "r", F.size("x").alias("n"), "max_tf", "min_dl", F.col("x.rows").alias("rows"), F.col("x.tfs").alias("tfs"))  # its bounds still hold
        empty = F.lit(None).cast(ranges.schema["ids"].dataType.elementType)
        ranges = ranges.join(lost, "r", "left").withColumn("ids", F.when(F.col("gone").isNull(), F.col("ids")).otherwise(F.transform("ids", lambda x, i: F.when(F.array_contains("gone", i), empty).otherwise(x)))).select("r", "ids", "dls")
    ranges.write.parquet(f"{path}/{name}")
    content = held | {"blocks": [_by_term(blocks, path)], "ranges": [name], "dead": []}
    snapshots.commit(spark, path, content, held["version"] + 1)
    return read(spark, path)


def _gain(weight: Column, tf: Column, dl: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come by r, a table for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        of = batch.column("r").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if held and held[0].column("r")[0].as_py() != of[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _scorer(asked: pa.Table, k: int, avgdl: float | None, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``Search.scores``: a range's row comes first, then its blocks by term. asked(query_id, term, weight)."""
    queries = asked.column("query_id").combine_chunks().unique()
    place = {q: i for i, q in enumerate(queries.to_pylist())}
    asks: dict[str, list[tuple[int, float]]] = {}
    for q, term, weight in zip(*(asked.column(x).to_pylist() for x in ("query_id", "term", "weight")), strict=True):
        asks.setdefault(term, []).append((place[q], weight))
    positive = all(w > 0 for x in asks.values() for _, w in x)
    held = len(place) * k <= HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(place), k), -np.inf) if held else None  # of each query so far
        for table in _whole(batches):
            about = table.slice(0, 1)
            if table.num_rows < 2 or about.column("term")[0].as_py() is not None:
                continue
            one = lambda x: about.column(x).combine_chunks().flatten()  # noqa: B023, E731
            ids, dls, blocks = one("ids"), one("dls").to_numpy(), table.slice(1)
            rows, tfs = blocks.column("rows").combine_chunks(), blocks.column("tfs").combine_chunks()
            of = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
            row, tf = rows.flatten().to_numpy(), tfs.flatten().to_numpy()
            gain = np.zeros((len(rows), len(ids)))
            gain[of, row] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls[row] / avgdl))
            here = [(q, j, w) for j, term in enumerate(blocks.column("term").to_pylist()) for q, w in asks[term]]
            q, j, w = (np.array(x) for x in zip(*here, strict=True))
            wanted = np.unique([place[x] for x in one("asks").to_pylist()])
            for at in range(0, len(wanted), AT_ONCE):
                some = wanted[at : at + AT_ONCE]
                mine = np.isin(q, some)
                by = np.searchsorted(some, q[mine]), j[mine]
                weights = np.zeros((len(some), len(rows)))
                weights[by] = w[mine]
                score = weights @ gain
                if not positive:
                    weights[by] = 1
                has = (score if positive else weights @ (gain > 0)) > 0
                if "gone" in about.column_names and about.column("gone")[0].is_valid:
                    has[:, one("gone").to_numpy()] = False
                score[~has] = -np.inf
                top = np.concatenate((best[some], score), axis=1) if held else score
                top = np.partition(top, -k, axis=1)[:, -k:] if top.shape[1] > k else top
                if held:
                    best[some] = top
                least = top.min(1) if top.shape[1] == k else np.full(len(some), -np.inf)
                a, b = np.nonzero(has & (score >= (least - SLACK)[:, None]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(some[a])), ids.take(pa.array(b)), pa.array(score[a, b])], names=names)

    return run


class Search:
    """A batch of queries(query_id, query) on an index: which ranges are opened, and the scores of their rows."""

    def __init__(self, index: Index, queries: DataFrame, k: int):
        self.index, self.k = index, k
        terms = queries.select("query_id", F.explode(normalize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        self._kept = _Scratch(queries.sparkSession).keep  # small tables, which the result reads
        # The index's rows are few for few terms: these are asked for by name.
        self.asked = small(self._kept(index.vocabulary.join(small(terms), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))))
        names = [r.term for r in self.asked.select("term").distinct().limit(NAMED + 1).collect()]
        self.blocks = index.blocks.where(F.col("term").isin(names)) if len(names) <= NAMED else index.blocks

    def bounds(self) -> DataFrame:
        """(query_id, r, most): what no row of a range scores more than."""
        rows = self.blocks.select("term", "r", "max_tf", "min_dl").join(self.asked, "term").join(F.broadcast(self.index.stats))
        most = F.greatest(_gain(F.col("weight"), F.col("max_tf"), F.col("min_dl")), F.lit(0.0))
        return rows.groupBy("query_id", "r").agg((F.sum(most) * (1 + 1e-9)).alias("most"))

    def scores(self, ranges: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of the living rows with a term of the query in the ranges (query_id, r), without such as k others of
        the same task exceed.

        The blocks of the asked terms are dealt by range, each once for all queries, and a range is scored as a product of the queries' weights
        with its terms' gains. Only with more than SENT terms are postings joined with the queries.
        """
        table = self.asked.limit(SENT + 1).toArrow()
        if table.num_rows > SENT:
            return self.joined(ranges)
        own, need = self.index, ranges.groupBy("r").agg(F.collect_set("query_id").alias("asks"))
        need = small(need, ROWS_ASKED)
        blocks = self.blocks.join(small(self.asked.select("term").distinct()), "term", "left_semi").join(need.select("r"), "r", "left_semi")
        where = own.ranges.join(need, "r")
        if own.dead is not None:
            where = where.join(small(own.dead.groupBy("r").agg(F.collect_list("row").alias("gone"))), "r", "left")
        both = where.unionByName(blocks.select("r", "term", "rows", "tfs"), allowMissingColumns=True)
        columns = ["r", "term", "rows", "tfs", "ids", "dls", "asks", *(["gone"] if own.dead is not None else [])]
        dealt = both.select(*columns).repartition("r").sortWithinPartitions("r", F.asc_nulls_first("term"))
        kinds = StructType([ranges.schema["query_id"], StructField("chunk_id", own.ranges.schema["ids"].dataType.elementType), StructField("score", DoubleType())])
        size = own.stats.first()
        scored = dealt.mapInArrow(_scorer(table, self.k, size.avgdl if size else None, kinds.fieldNames()), kinds)
        return scored.withColumn("score", F.round("score", 6))

    def joined(self, ranges: DataFrame) -> DataFrame:
        """The scores of all living rows of the ranges, by joins."""
        need = small(ranges.select("query_id", "r").join(self.asked, "query_id"))
        hits = _opened(self.blocks.select("term", "r", "rows", "tfs").join(need, ["term", "r"]), self.index).join(F.broadcast(self.index.stats))
        scored = hits.groupBy("query_id", "r", "row", "chunk_id").agg(F.round(F.sum(_gain(F.col("weight"), F.col("tf"), F.col("dl"))), 6).alias("score"))
        return scored.select("query_id", "chunk_id", "score")

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The scores of the ranges that promise most, k for each query; those ranges, and the others that may hold one of a query's best k."""
        bounds = self._kept(self.bounds())
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "r"))
        first = self._kept(bounds.withColumn("rank", order).where(F.col("rank") <= self.k).select("query_id", "r"))
        scored = self._kept(self.scores(first))
        kth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        least = scored.withColumn("rank", kth).where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(small(least), "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - SLACK))
        return scored, first, self._kept(rest.join(small(first), ["query_id", "r"], "left_anti").select("query_id", "r"))


def search(index: Index, queries: DataFrame, k: int = 10, positive: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the best k rows per query; ties by chunk_id. queries(query_id, query).

    Bounds are read of all ranges with a term of the queries (of terms that are NAMED or fewer, only pages of the files that may have them); postings
    only of the ranges that promise most and, once these have given a k-th score, of those that may still reach it.
    """
    asked = Search(index, queries, k)
    scored, _, rest = asked.run()
    scores = scored.unionByName(asked.scores(rest))
    if positive:
        scores = scores.where("score > 0")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", best).where(F.col("rank") <= k)
