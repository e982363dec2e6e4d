import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from lutrin.llm import pii, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, Row string, Keys int"
STAGES = dict(corpus_pipeline.STAGES)


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(n))


def table(spark, rows):
    """(doc_id, text) rows with nulls in the other columns, and columns that no stage knows."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 else "s", len(t) if t and k % 2 else None, "x", "y", k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark, tmp_path_factory):
    """A folder like the tables': benchmark items, one of them null, one short."""
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, prose("item", 14)), (2, None), (3, "short item"), (4, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def odd():
    long = prose("long", 30_000)
    return [(1, prose("a")), (1, prose("a")), (2, None), (2, ""), (None, prose("b")), (3, long), (4, long), (5, " \n\t "), (6, f"{prose('c')} {prose('item', 14)} {prose('d')}"), (7, f"{prose('e')} joe@mail.org {prose('f')}"), (8, "one two")]


def run(spark, name, rows, path):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in STAGES[name](spark, table(spark, rows), path).collect()]


def test_stages_keep_the_columns_and_drop_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and not out.collect()
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(out) < 200 and out.doc_id.is_unique and (out.ids.map(len) == out.n_tokens).all()


def test_quality_stage(spark, benchmark):
    rows = odd()
    got = run(spark, "quality", rows, benchmark)
    passing = [(i, t) for i, t in rows if t and len(t.split()) >= 50 and 2 * quality.repeated_words(t.encode().split()) <= len(t.split())]
    assert sorted((i or 0, t) for i, t, *_ in got) == sorted((i or 0, t) for i, t in passing)


def test_near_duplicates_stage(spark, benchmark):
    rows = odd()
    got = run(spark, "near_duplicates", rows, benchmark)
    sets = {t: frozenset(simhash.shingles((t or "").encode(), 5)) for _, t in rows}
    best = {}
    for i, t in rows:  # of each set of shingles the least id, null last; no two sets here are alike without being equal
        best[sets[t]] = min(best.get(sets[t], (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, *_ in got) == sorted(best.values())


def test_decontamination_stage(spark, benchmark):
    rows = odd()
    got = {(i, t): n for i, t, _, _, n in run(spark, "decontamination", rows, benchmark)}
    for k, (i, t) in enumerate(rows):
        if i == 6:
            left = t.replace(prose("item", 14), "")
            assert got[i, left] == len(left)
        else:
            assert (i, t) in got


def test_personal_data_stage(spark, benchmark):
    rows = odd()
    got = {(i, t) for i, t, *_ in run(spark, "pii", rows, benchmark)}
    names = pii.Pseudonyms(corpus_pipeline.DEMONSTRATION_KEY)
    assert got == {(i, t if t is None else names.replace(t)[0]) for i, t in rows} and not any("joe@" in (t or "") for _, t in got)


def test_encoding_stage(spark, benchmark):
    rows = odd()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = STAGES["bpe"](spark, table(spark, rows), benchmark).collect()
    want = sorted((i or 0, hashlib.sha256(t).hexdigest()) for i, t in ((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()) for i, t in rows))
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in out) == want


def test_copies_are_dropped_by_row(spark):
    """Repeated rows, rows that share a doc_id but not a text, rows without a doc_id."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(100))
    rows = [(1, text("a")), (2, text("b")), (2, text("b")), (3, text("a")), (3, text("c")), (None, text("d")), (None, text("d")), (None, text("b")), (4, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in left) == sorted([(1, text("a")), (2, text("b")), (3, text("c")), (0, text("d")), (4, text("e"))])


def test_a_near_copy_and_another_text_of_one_id(spark):
    """The text that isn't a copy stays, though it has a copy's doc_id."""
    text = prose("x", 200)
    rows = [(1, text), (2, text.rsplit(" ", 3)[0]), (2, prose("y", 200))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [(1, text), (2, prose("y", 200))]
