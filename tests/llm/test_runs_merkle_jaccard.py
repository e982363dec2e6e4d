"""Periodic runs, the Merkle manifest and the Jaccard join against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lutrin.llm import groups, jaccard, merkle, queries, runs, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, runs string, root string, id string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(values):
    return sorted(tuple(map(str, r)) for r in values)


# Runs


def plain_runs(w):
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            x = w[start : i + q]
            if len(x) >= max(24, 3 * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.add((start, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said), sha(kept))


def test_runs_of_numbers():
    r = random.Random(1)
    for _ in range(400):
        n = r.randint(0, 150)
        w = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 30 else 0):
            a, p = r.randrange(n), r.randint(1, 20)
            for i in range(a, min(n, a + r.randint(20, 90))):
                w[i] = w[a + (i - a) % p]
        assert [tuple(x) for x in runs.find(np.array(w, np.int64)).tolist()] == plain_runs(w)


def test_runs_in_small_blocks(monkeypatch):
    w = np.array(([1, 2, 3] * 20 + list(range(10, 40))) * 4)
    whole = runs.find(w)
    monkeypatch.setattr(runs, "GRID", 7)
    assert (runs.find(w) == whole).all() and len(whole)


def test_runs_of_texts(spark):
    r = random.Random(2)
    texts = [None, "", " \n", "a " * 24, "a " * 23, "é b " * 12, "x" * 5000, "a b c " * 9 + "d", "y " + "a b " * 13 + "z " * 30]
    texts += [" ".join(r.choices("abcdef", k=r.randint(0, 120))) for _ in range(120)]
    rows = [(i if i != 4 else None, t, "l", "s", 1, "n", "r", "q", "i") for i, t in enumerate(texts)]
    rows += rows[3:5]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = runs.collapse(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "root", "id", "n_words", "runs", "collapsed"]
    want = [(d, len((t or "").split()), plain_runs((t or "").split())) for d, t, *_ in rows]
    assert rows_of(want) == rows_of((x.doc_id, x.n_words, [tuple(y) for y in x.runs]) for x in out.collect())
    assert not runs.collapse(spark.createDataFrame([], SCHEMA)).collect()


def test_op11_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 9000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    want = [plain_digests(r.doc_id, r.text) for r in docs]
    assert rows_of(want) == rows_of(got[w[0]] for w in want) and any(w[1] for w in want)


# Manifest


def plain_manifest(rows, tampered):
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(mark(r.doc_id) + mark(r.source) + mark(r.lang) + mark(r.n_chars) + mark(t))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def proof(levels, i):
        out = []
        for nodes in levels[:-1]:
            a = i // 8 * 8
            out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
            i //= 8
        return out

    by = defaultdict(list)
    for r in rows:
        by[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, (k, levels) in enumerate(zip(langs, trees, strict=True)):
        for i, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = proof(levels, i) + proof(top, j)
            low = tampered and r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if low else r.text)
            for before, after in path:
                node = sha(before + node + after)
            out.append((r.doc_id, own, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def test_op12_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op12_merkle_manifest(spark, SF).collect()
    assert rows_of(got) == rows_of(plain_manifest(docs, True)) and {r.verified for r in got} == {True, False}


@pytest.fixture(scope="module")
def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.concat("lang", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 90).otherwise(0).cast("string"))))
    none = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))
    rows = docs.union(docs.limit(20)).union(none).collect()
    return spark.createDataFrame(rows, docs.schema).repartition(3), rows


@pytest.mark.parametrize(("top", "levels"), [(4096, 4), (9, 1), (200, 1), (10, 2)])
def test_manifest_by_rounds(spark, odd_documents, top, levels):
    """Many trees or few, nulls, repeated rows; upper levels by the driver alone, or by rounds of blocks."""
    df, rows = odd_documents
    got = merkle.manifest(df.withColumn("root", F.lit("x")), ["doc_id", "source", "lang", "n_chars", "text"], top=top, levels=levels).collect()
    assert rows_of(got) == rows_of(plain_manifest(rows, False)) and all(r.verified for r in got)


def test_manifest_of_few(spark):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    assert not merkle.manifest(spark.createDataFrame([], SCHEMA), columns).collect()
    one = merkle.manifest(spark.createDataFrame([(1, "t", None, None, 3, "n", "r", "q", "i")], SCHEMA), columns).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:1--1:31:t") and one.proof_sha256 == sha("") and one.verified


# Jaccard join


def plain_links(rows, words=3, p=9, q=10):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b"\0".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    first, having = {}, defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            up[find(i)] = find(first.setdefault(s, i))
    for s, i in first.items():
        common = defaultdict(int)
        for x in s:
            for j in having[x]:
                common[j] += 1
            having[x].append(i)
        for j, n in common.items():
            if n * q >= p * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = known if d is None or known is not None and known < d else d
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def family(r, sizes, copies):
    words, out = [f"w{i}" for i in range(5000)], []
    for n in sizes:
        w = r.choices(words, k=n + 2)
        out.append(" ".join(w))
        for c in range(1, copies + 1):
            out += [" ".join(w[:-c]), " ".join(w + r.choices(words, k=c))]
            x = list(w)
            x[r.randrange(len(x))] = "zz"
            out.append(" ".join(x))
    hub = r.choices(words, k=200)
    for _ in range(150):
        x = list(hub)
        for _ in range(3):
            x[r.randrange(200)] = r.choice(words)
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("block", [2000, 40])
def test_links(spark, monkeypatch, block):
    """Sets at, above and under the threshold, of all small sizes; a star whose ends aren't alike; nulls, empty texts, repeated rows and ids."""
    monkeypatch.setattr(groups, "BLOCK_ROWS", block)
    monkeypatch.setattr(groups, "HUB_ROWS", block // 2)
    rows = list(enumerate(family(random.Random(3), [*range(1, 40), 90, 300], 2)))
    rows += [(None, "a b c d e"), (7, "A b c d e"), (7, None), (8, ""), (None, None), (3, "zz yy"), (3, "zz yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_shingles", F.lit("x")).withColumn("id", F.lit(1))
    assert rows_of(jaccard.link(df).collect()) == rows_of(plain_links(rows))
    assert not jaccard.link(df.limit(0)).collect()


def test_op13_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_ngram_jaccard(spark, SF).collect()
    assert rows_of(got) == rows_of(plain_links(docs)) and any(r.component_id != r.doc_id for r in got)


def test_trees_prune_and_lose_nothing():
    """Of sets in clusters the traversal gives all alike pairs, and tests few pairs of nodes of the many."""
    r = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = r.integers(0, 1 << 63, 120, dtype=np.uint64)
        for _ in range(8):
            x = base.copy()
            x[:4] = r.integers(0, 1 << 63, 4, dtype=np.uint64)
            sets.append(x)
    bits, n = np.stack([jaccard.signature(x) for x in sets]), np.array(list(map(len, sets)))
    tree = jaccard.Tree(bits, n, np.arange(len(sets)))
    found = {tuple(sorted(p)) for i, j in jaccard.traverse(tree, tree, Fraction(9, 10)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    alike = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i // 8 == j // 8}
    assert alike <= found and len(found) < 2 * len(alike)
    one, two = jaccard.Tree(bits[:200], n[:200], np.arange(200)), jaccard.Tree(bits[200:], n[200:], np.arange(200, 480))
    assert not list(jaccard.traverse(one, two, Fraction(9, 10)))


@pytest.mark.parametrize("similarity", [Fraction(9, 10), Fraction(4, 5)])
def test_part_keys(similarity):
    """Any two different sets that are as alike as asked share a key."""
    r = np.random.default_rng(6)
    for n in [*range(1, 90), 150, 400]:
        base = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for m in range(1, 60):
            other = np.r_[base, r.integers(0, 1 << 63, m, dtype=np.uint64)]
            if Fraction(n, n + m) < similarity:
                break
            a, b = groups.part_keys([base, other], similarity)
            assert set(a.tolist()) & set(b.tolist()), (n, m)


def test_near_copies_of_all_small_sizes(spark):
    """Pairs of s shingles and the most that are added at 0.8, for every s up to 60."""
    r = random.Random(9)
    words, rows, pairs = [f"w{i}" for i in range(5000)], [], []
    for s in range(1, 61):
        for _ in range(6):
            w = r.choices(words, k=s + 4)
            pairs.append(len(rows))
            rows += [" ".join(w), " ".join(w + r.choices(words, k=s // 4))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    root = dict(map(tuple, simhash.near_copies(df).collect()))
    found = sum(root.get(i, i) == root.get(i + 1, i + 1) for i in pairs)
    assert found >= 0.99 * len(pairs)
