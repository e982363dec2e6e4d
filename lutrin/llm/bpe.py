"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The automaton reads tokens and accepts just the sequences that the merges give. It starts as one state
with an arc for each byte; each merge (u, v) in turn is a gadget: where u and then v could be read, an arc
uv is added, and the state that u leads to is split off without its arc v. All arcs of a token thus lead to
one state. A state is kept as what gadgets took from it: ``removed[u][v]`` is the number of the merge, and a
token's state takes over what had been taken from its right part's state before the token was born. An arc
is there unless it, or a left part of it before that part's merge, was taken away. Rows of the transition table
are worked out on the first visit and kept.

Every prefix of a word has one accepted token sequence, so a position is reached in one state only, and the
walk below, longest arcs first, visits each position once at most.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import NOT_PLAIN, fresh, letters_digits

NEVER = 1 << 60
#: Words whose ids a worker keeps, and transitions.
KEPT_WORDS = 200_000
KEPT_ARCS = 400_000
KEPT_STATES = 10_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """labels: bytes of each token; merges: (left, right, token) ids in order of rank."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.removed: dict[int, dict[int, int]] = {}
        for k, (u, v, uv) in enumerate(merges):
            if uv in self.born or not self._arc(self._taken(u), v, k):
                continue  # no path reads u and then v any more: the merge can't apply
            self.born[uv] = k
            self.parts[uv] = (u, v)
            self.removed.setdefault(u, {})[v] = k
        live = {t for u, v, t in merges if t in self.born}
        merged = {t for _, _, t in merges}
        self.ids = {x: t for t, x in labels.items() if t in live or (t not in merged and len(x) == 1)}
        lengths: dict[bytes, set[int]] = {}
        for x in self.ids:
            lengths.setdefault(x[:3], set()).add(len(x))
        #: The first bytes of a token -> the lengths of tokens that begin so, longest first.
        self.lengths = {x: sorted(y | set(range(1, min(len(x), 2) + 1)), reverse=True) for x, y in lengths.items()}
        self._known: dict[int, bool] = {}
        self._states: dict[int, dict[int, int]] = {}

    def _taken(self, token: int) -> dict[int, int]:
        """What is missing from a token's state, with the merge that took it."""
        out: dict[int, int] = {}
        before, state = NEVER, token
        while True:
            for v, k in self.removed.get(state, {}).items():
                if k < before:
                    out[v] = min(k, out.get(v, k))
            if state not in self.parts:
                return out
            before, state = self.born[state], self.parts[state][1]

    def _arc(self, taken: dict[int, int], token: int, now: int = NEVER) -> bool:
        """Is there an arc of the token from a state after ``now`` gadgets?"""
        until = now
        while True:
            k = taken.get(token)
            if k is not None and k <= until and k < now:
                return False
            if token not in self.parts:
                return True
            until, token = self.born[token], self.parts[token][0]

    def arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        got = self._known.get(key)
        if got is None:
            if len(self._known) >= KEPT_ARCS:
                self._known.clear()
            taken = self._states.get(state)
            if taken is None:
                taken = self._taken(state)
                if len(self._states) < KEPT_STATES:
                    self._states[state] = taken
            got = self._known[key] = self._arc(taken, token)
        return got

    def encode(self, word: bytes) -> list[int]:
        """The ids of a pre-split word."""
        ids, lengths = self.ids, self.lengths.get
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        n, known, arc = len(word), self._known, self.arc
        path, ends, last = [], [0], -1
        left = [iter(lengths(word[:3], (2, 1)))]
        seen = bytearray(n + 1)
        at = 0
        while at < n:
            for x in left[-1]:
                end = at + x
                if end > n or seen[end]:
                    continue
                token = ids.get(word[at:end])
                if token is not None and (last < 0 or (known[key] if (key := last << 32 | token) in known else arc(last, token))):
                    seen[end] = 1
                    path.append(token)
                    ends.append(end)
                    left.append(iter(lengths(word[end : end + 3], (2, 1))))
                    at, last = end, token
                    break
            else:
                if not path:
                    raise ValueError(f"no token sequence for {word!r}")
                path.pop()
                ends.pop()
                left.pop()
                at, last = ends[-1], path[-1] if path else -1
        return path

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, joined."""
        return b"".join(map(self.labels.__getitem__, ids))


class Tokenizer:
    """A byte-level vocabulary file of the tokenizers library, encoded by the automaton."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        to_byte = byte_alphabet()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        labels = {i: bytes(to_byte[c] for c in x) for x, i in vocab.items()}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.labels = labels | {i: x.encode() for x, i in added.items()}
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        space = r"\t-\r \x85\xa0"
        letter, digit = letters_digits()
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")
        self._spec, self._slow = text, None
        self._known: dict[str, bytes] = {}
        self._table = [self.labels.get(i, b"") for i in range(max(self.labels) + 1)]

    def pieces(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text):
            return self.split.findall(text)
        if self._slow is None:
            from tokenizers import Tokenizer as Library

            self._slow = Library.from_str(self._spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._slow.pre_tokenize_str(text)]

    def _piece(self, piece: str) -> bytes:
        ids = self.automaton.encode(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self._known) < KEPT_WORDS and len(piece) < 64:
            self._known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special and self.special.search(text):
            return b"".join(struct.pack("<I", self.added[x]) if x in self.added else self._plain(x) for x in self.special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, new = self._known.get, self._piece
        return b"".join([known(x) or new(x) for x in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text; bytes that aren't UTF-8 are replaced, as the library does."""
        out = b"".join(map(self._table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace").encode()


@lru_cache(maxsize=1)
def tokenizer_of(spec: str) -> Tokenizer:
    """A worker's tokenizer, with the words that it knows from task to task."""
    return Tokenizer(spec)


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", ids: bool = True) -> DataFrame:
    """df with ``ids`` (array of int, the whole text's; optional), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    vocabulary: the path of a byte-level vocabulary file, read on the driver and sent to the workers (1.6 MB).
    Null text is empty text: no ids, hashes of the empty string. An empty table gives an empty table. Columns of df
    that have the new ones' names are replaced; all others stay. Repeated rows give repeated rows.
    """
    spec = df.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    new = [StructField("n_tokens", T.LongType()), StructField("ids_sha256", T.StringType()), StructField("decoded_sha256", T.StringType())]
    new = [StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids + new
    source = fresh(df, "text")
    names = {x.name for x in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = StructType(kept + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(at, 256)
                codes = [tokenizer.encode(x or "") for x in batch.column(source).to_pylist()]
                out = [batch.column(f.name) for f in kept]
                if ids:
                    flat = np.frombuffer(b"".join(codes), "<u4").astype(np.int32)
                    ends = np.cumsum([0, *(len(x) // 4 for x in codes)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                out.append(pa.array([len(x) // 4 for x in codes], pa.int64()))
                out.append(pa.array([hashlib.sha256(x).hexdigest() for x in codes]))
                out.append(pa.array([hashlib.sha256(tokenizer.decode(x)).hexdigest() for x in codes]))
                yield pa.RecordBatch.from_arrays([x.cast(pa.string()) if x.type == pa.null() else x for x in out], names=[f.name for f in schema.fields])

    given = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias(source))
    return given.mapInArrow(run, schema)
