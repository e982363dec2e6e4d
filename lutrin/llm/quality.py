"""Quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains (-1). Expectation-maximisation over the counts of vote patterns estimates
how often each rule gives each vote for good and for bad texts, and the share of good ones; a text is kept by its posterior
probability of being good, not by passing all rules. Patterns number at most 3 to the number of rules, so their counts, over
all documents, are what the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import chunks, fresh, others, settle

#: The features of a text, all whole numbers.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_lines", "n_noisy_lines")
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
NOT_CONTINUATION = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def measure(text: bytes) -> tuple[int, ...]:
    """FEATURES of a text in UTF-8. A noisy line has a symbol or exclamation mark for every third word at least."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - len(text.translate(None, NOT_CONTINUATION))
    symbols = len(text.translate(None, NOT_SYMBOL))
    marks = text.count(b"!")
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    noisy = 0
    if 3 * (symbols + marks):
        noisy = sum(3 * (len(x.translate(None, NOT_SYMBOL)) + x.count(b"!")) >= len(x.split()) for x in lines)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words), marks, len(lines), noisy


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that are found twice or more among the words, the first included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    code = ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, n)
    for i in range(1, window):
        if len(numbers) ** 2 >= 1 << 62 or int(code.max()) * len(numbers) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code[:-1] * len(numbers) + ids[i:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(window):
        covered[i : n - window + 1 + i] |= twice
    return int(covered.sum())


def votes() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, -1 abstains. Columns are the FEATURES."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))

    def rule(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull() | (c("n_words") == 0), F.lit(-1)).when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(-1))

    symbols, marks, length = c("n_symbols") / n, c("n_marks") / n, c("word_chars") / n
    repeats, lines = c("n_repeat_words") / n, F.greatest(c("n_lines"), F.lit(1))
    return {
        "symbols": rule(symbols, symbols <= 0.02, symbols >= 0.2),
        "marks": rule(marks, marks <= 0.02, marks >= 0.2),
        "repeats": rule(repeats, repeats <= 0.15, repeats >= 0.4),
        "lines": rule(lines, c("n_dup_lines") / lines <= 0.1, c("n_dup_lines") / lines >= 0.4),
        "noise": rule(lines, c("n_noisy_lines") / lines <= 0.1, c("n_noisy_lines") / lines >= 0.5),
        "length": rule(length, (length >= 3) & (length <= 10), (length < 2) | (length > 16)),
        "words": rule(n, c("n_words") >= 50, c("n_words") < 20),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability of being good for each pattern (rows: votes of each rule).

    Votes are independent given the class, abstaining included. It starts from the balance of votes, a bad one counting as
    three good ones, and each vote of each rule counts once more than seen, so that no probability is 0. A rule's bad
    vote is taken as evidence against a text: the rule's estimated odds for it are kept at 1 to 2 at most.
    """
    if not len(counts):
        return np.zeros(0)
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = 1 / (1 + np.exp(np.clip(3.0 * bad - good, -30, 30)))
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        table = np.einsum("cp,prv->crv", w, one_hot) + 1.0
        table /= table.sum(2, keepdims=True)
        odds = np.log(table[1]) - np.log(table[0])
        odds[:, 1] = np.minimum(odds[:, 1], -np.log(2))
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        new = np.log(prior[1]) - np.log(prior[0]) + np.einsum("prv,rv->p", one_hot, odds)
        new = 1 / (1 + np.exp(-np.clip(new, -500, 500)))
        done = np.abs(new - p).max() < 1e-12
        p = new
        if done:
            break
    return p


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with FEATURES (long) in place of columns of those names, in any case; the text column stays only if df needs it itself.

    Null and empty texts have zeros. Rows are independent and repeated rows alike; an empty table gives an empty table.
    """
    source = fresh(df, "text")
    kept = others(df, FEATURES)
    schema = StructType([*kept, *(StructField(x, T.LongType()) for x in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, source):
                part = batch.slice(a, b - a)
                columns = list(zip(*map(measure, texts), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(pa.array(x, pa.int64()) for x in columns)], names=schema.fieldNames())

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)


def judge(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with FEATURES, ``base_failed``, ``good`` (posterior probability) and ``kept``.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows; such texts aren't kept.
    The model is fitted on all rows. Null text has no words. An empty table gives an empty table; repeated rows
    count as often as they are there; columns of df with the new names, in any case, are replaced. Features are written to the shared folder
    once, as the patterns are counted before they are used.
    """
    made = {"base_failed", "good", "kept"}
    rules = votes()
    df = df.select(*(F.col(f"`{f.name}`") for f in others(df, {*made, *FEATURES} - {text.lower()})))
    seen = settle(features(df, text))
    pattern = F.concat_ws(",", *(v.cast("string") for v in rules.values()))
    key = fresh(seen, "votes")
    seen = seen.withColumn(key, pattern)
    rows = sorted((r[key], r["count"]) for r in seen.groupBy(key).count().collect())
    patterns = np.array([list(map(int, k.split(","))) for k, _ in rows]).reshape(len(rows), len(rules))
    p = expectation_maximisation(patterns, np.array([n for _, n in rows], float))
    table = df.sparkSession.createDataFrame([(k, float(x)) for (k, _), x in zip(rows, p, strict=True)], f"`{key}` string, good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.join(F.broadcast(table), key, "left").drop(key).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("good") >= threshold))
