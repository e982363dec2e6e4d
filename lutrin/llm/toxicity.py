"""Toxicity by a weighted lexicon.

Text is folded (case, homoglyphs, digits and signs for letters), the lexicon is matched by an Aho-Corasick automaton at word starts,
hits inside exception phrases don't count, and the weights' sum is normalised by length and turned into a probability. Lexicon,
weights, exceptions and the curve are learnt from labelled texts: the workers count terms and phrases, and the driver gets the counts of terms
that are much likelier in toxic texts, which of those each text has, and a number for each text, never the texts.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import Tables, fresh, others

#: Labelled rows of each class that the lexicon is learnt from at most: those of least hash of their id.
FIT_ROWS = 5000
#: Letters of the beginnings of words that are terms, beside whole words: from the shortest to the longest. (What a documented
#: parameter bounds is the form of a term, not which texts or words are looked at.)
LONGEST, SHORTEST = 12, 3
#: How many times likelier a term is in toxic texts, at least.
LEAST_RATE = 8
#: Letters of other scripts that look like Latin ones, and signs that stand for letters inside a word.
HOMOGLYPHS = dict(zip("авеёкмнорстухіјѕԁԛԝαβεικνορτυχγ", "abeekmhopctyxijsdqwabeiknoptuxy", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
OTHER_SCRIPT = re.compile(r"[Ͱ-ӿԀ-ԯ！-～​-‍­]")
GLYPHS = {ord(a): b for a, b in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
SIGN = re.compile(r"(?<=[a-z])[0134578@$!]+(?=[a-z])|(?<![^\s])[0134578@$](?=[a-z]{2})")
WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    text = text.lower()
    if OTHER_SCRIPT.search(text):
        text = text.translate(GLYPHS).lower()
    return SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)


@dataclass
class Lexicon:
    """terms with weights: whole words (with a blank after them) and beginnings of longer words (with a +); exceptions: folded phrases.

    An empty one, as of no labels, finds nothing in any text, null and empty ones among them.
    """

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    slope: float = 0.0
    offset: float = -4.0

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.terms:
            return None
        found = ahocorasick.Automaton()
        for x in {x[:-1] for x in self.terms}:
            found.add_word(x, (x, True))
        for x in self.exceptions:
            if x not in found:
                found.add_word(x, (x, False))
        found.make_automaton()
        return found

    def hits(self, text: str, matcher: ahocorasick.Automaton) -> list[tuple[str, int]]:
        """Lexicon terms at word starts in a folded text, outside of exceptions, the longest at each place."""
        best: dict[int, str] = {}
        free: list[tuple[int, int]] = []
        for end, (x, term) in matcher.iter(text):
            a, b = end - len(x) + 1, end + 1
            if a and text[a - 1].isalnum():
                continue
            closed = b == len(text) or not text[b].isalnum()
            if not term:
                if closed:
                    free.append((a, b))
                continue
            name = f"{x} " if closed else f"{x}+"
            if name in self.terms and len(name) > len(best.get(a, "")):
                best[a] = name
        return [(x, a) for a, x in sorted(best.items()) if not any(p <= a < q for p, q in free)]

    def feature(self, text: str, matcher: ahocorasick.Automaton | None) -> float:
        folded = fold(text)
        if matcher is None:
            return 0.0
        total = sum(self.terms[x] for x, _ in self.hits(folded, matcher))
        return total / math.log(math.e + folded.count(" ")) if total else 0.0

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * x + self.offset))))


def choose(where: dict[str, list[int]], rate: dict[str, float], n_toxic: int, least: int) -> list[str]:
    """Terms of a lexicon from where (the toxic texts that each candidate is in) and rate (how many times likelier it is in toxic texts).

    A term is taken if it covers ``least`` toxic texts that the terms taken so far don't; what it newly covers counts by how sure it is, and among
    equals the longest beginning is taken. Terms that a good part of the toxic texts have and clean ones don't are taken even if others
    cover them. All candidates are considered: gains only fall, so a candidate whose gain is unchanged at the top of the heap is the best of all.
    """
    left, chosen = set(range(n_toxic)), []
    gain = lambda x: len(left.intersection(where[x]))
    key = lambda x: (-gain(x) * math.log(rate[x]), -len(x), x)
    heap = [key(x) for x in where]
    heapq.heapify(heap)
    while left and heap:
        top = heapq.heappop(heap)
        now = key(top[2])
        if now != top:
            heapq.heappush(heap, now)
            continue
        if gain(top[2]) < least:
            break
        chosen.append(top[2])
        left -= set(where[top[2]])
    for x in sorted((x for x in where if len(where[x]) >= 0.04 * n_toxic and rate[x] >= 20), key=lambda x: (-len(x), x)):
        if not any(y[:-1].startswith(x[:-1]) or x[:-1].startswith(y[:-1]) for y in chosen):
            chosen.append(x)
    return chosen


def _terms(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORD.findall(text)):
        if len(w) >= SHORTEST and not w[0].isdigit():
            out.update(f"{w[:i]}+" for i in range(SHORTEST, min(len(w) - 1, LONGEST) + 1))
            out.add(f"{w} ")
    return out


def _phrases(text: str, places: list[int]) -> set[str]:
    """The word that begins at each place with the one before it, and with the one after it."""
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    out = set()
    for at in places:
        i = bisect_right(starts, at) - 1
        own = text[at : words[i][1]]
        if starts[i] < at or i:
            out.add(f"{text[starts[i] : at] if starts[i] < at else text[slice(*words[i - 1])]} {own}")
        if i + 1 < len(words):
            out.add(f"{own} {text[slice(*words[i + 1])]}")
    return out


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A slightly regularised logistic curve by Newton's method."""
    design = np.stack([x, np.ones_like(x)], 1)
    beta, ridge = np.zeros(2), np.diag([0.01, 0.0001])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, beta[0])), float(beta[1])


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, rows: int = FIT_ROWS) -> Lexicon:
    """Learn from at most ``rows`` labelled rows of each class, those of least hash of their id; usable: a condition on labels.

    Rows of labels without an id or with a label other than 0 and 1 are left out, as are null texts; equal texts of a class count once. Whole
    texts are read. Without toxic texts the lexicon is empty; an empty table of either kind gives such. Other columns don't matter.
    """
    own = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull())
    own = (own.where(usable) if usable is not None else own).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("y"))
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    tables = Tables(df.sparkSession)
    found = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    found = tables.settle(found.join(F.broadcast(some[0].union(some[1])), "id").select(F.col("y").cast("int").alias("y"), "t").distinct())
    n = {r.y: r.n for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    out = Lexicon(offset=math.log(max(share, 1e-4) / max(1 - share, 1e-4)) if n else -4.0)
    if not n_toxic:
        tables.drop()
        return out
    # So many texts, all toxic, that no term has them by chance.
    odds = n_toxic / (n_toxic + n_clean)
    least = max(3, n_toxic // 500, math.ceil(math.log(1e-8) / math.log(odds)) if odds < 1 else 3)
    ratio = ((F.col("n1") + 0.5) / (n_toxic + 1)) / ((F.col("n0") + 0.5) / (n_clean + 1))
    terms = _counted(found, lambda x: _terms(fold(x))).where(F.col("n1") >= least).withColumn("rate", ratio).where(F.col("rate") >= LEAST_RATE)
    rate = {r.x: r.rate for r in terms.select("x", "rate").collect()}
    has = _each(found.where("y = 1"), lambda x: sorted(_terms(fold(x)) & rate.keys()), "array<string>").collect()
    where: dict[str, list[int]] = {x: [] for x in rate}
    for i, r in enumerate(has):
        for x in r.x:
            where[x].append(i)
    out.terms = {x: math.log(rate[x]) for x in choose(where, rate, n_toxic, least)}

    def phrases(text: str) -> set[str]:
        folded = fold(text)
        return _phrases(folded, [a for _, a in out.hits(folded, _matcher(out))])

    if out.terms:
        out.exceptions = {r.x for r in _counted(found, phrases).where("n0 >= 2 and n1 = 0").select("x").collect()}
    features = np.array(sorted((r.y, r.x) for r in _each(found, lambda x: out.feature(x, _matcher(out)), "double").collect()))
    tables.drop()
    y, x = features.T
    weight = np.where(y == 1, share / n_toxic, (1 - share) / max(1, n_clean)) * len(y)
    out.slope, out.offset = _curve(x, y, weight)
    return out


def _matcher(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    """The lexicon's automaton, made once where it is used."""
    if "made" not in lexicon.__dict__ or lexicon.made[0] != (len(lexicon.terms), len(lexicon.exceptions)):
        lexicon.made = ((len(lexicon.terms), len(lexicon.exceptions)), lexicon.matcher())
    return lexicon.made[1]


def _each(found: DataFrame, function: Callable[[str], object], kind: str) -> DataFrame:
    """(y, x): what the function gives of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.list_(pa.string()) if kind.startswith("array") else pa.float64()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([function(x.as_py()) for x in batch.column("t")], to)], names=["y", "x"])

    return found.mapInArrow(run, f"y int, x {kind}")


def _counted(found: DataFrame, function: Callable[[str], set[str]]) -> DataFrame:
    """(x, n1, n0): the toxic and clean texts that each string which the function gives of a text is of; summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for y, x in zip(batch.column("y").to_pylist(), batch.column("t"), strict=True):
                seen[y].update(function(x.as_py()))
            keys = sorted(seen[0].keys() | seen[1].keys())
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([seen[y][x] for x in some], pa.int64()) for y in (1, 0))], names=["x", "n1", "n0"])

    return found.mapInArrow(run, "x string, n1 long, n0 long").groupBy("x").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """df with ``score`` (0 to 1), ``predicted`` (int) and ``hits`` (array of matched terms) of each whole text.

    Null and empty texts have no hits and the score of such. Rows are independent, so ties, repeated rows and empty tables need nothing special;
    columns of df with the new names, in any case, are replaced. Without labelled texts the lexicon is empty and all scores are equal.
    """
    sent = df.sparkSession.sparkContext.broadcast(lexicon)
    source = fresh(df, "text")
    kept = others(df, ("score", "predicted", "hits"))
    schema = StructType([*kept, StructField("score", T.DoubleType()), StructField("predicted", T.IntegerType()), StructField("hits", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        matcher = own.matcher()
        for batch in batches:
            scores, hits = [], []
            for x in batch.column(source):
                text = x.as_py() or ""
                f = own.feature(text, matcher)
                scores.append(own.score(f))
                hits.append([t[:-1] for t, _ in own.hits(fold(text), matcher)] if f else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, pa.list_(pa.string()))], names=schema.fieldNames())

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)
