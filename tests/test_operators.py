import re

import duckdb
from pyspark.sql import functions as F

from lutrin.functions import text as X
from lutrin.operators import chunks, evaluate, fusion, layout, segment, windows


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "t string").select(function("t").alias("x")).first().x


def test_text(spark):
    dirty = "  a\r\n\n\rb\x1c \U0001f600\U0001f601c  "
    python = re.sub("[\U00010000-\U0010ffff]+", " ", re.sub("\n+", "\n", re.sub("\r\n?", "\n", dirty))).strip()
    assert one(spark, X.clean, dirty) == python
    assert one(spark, X.normalize, "L'Article n° 24-440, de\x1cla") == ["larticle", "n°", "24440", "de", "la"]
    assert one(spark, X.normalize, "") == []
    assert one(spark, X.remove_arabic, "aس﻿b") == "ab"


def test_segment(spark):
    g = "x\nDÉCRET exécutif n° 5 du jour. ---\nIntro\nDécrète :\nArt. 1er. - un\nLe Président\nArt. 2 - deux\nFait à Alger\nfin\nDécision du 3. ----\nsans rien\nARRÊTÉ du 3 mars sans tirets.\nArticle 1er - a. ----\nz"
    d = segment.segment(spark.createDataFrame([("a", g), ("b", ""), ("c", None)], "source string, text string"))
    rows = {r.source_file: r for r in d.collect()}
    assert rows["b"].total_documents == 0 == rows["c"].total_documents
    docs = rows["a"].documents
    assert [x.title for x in docs] == ["DÉCRET exécutif n° 5 du jour.", "Décision du 3."]
    assert docs[0].articles == ["Art. 1er. - un Le Président", "Art. 2 - deux"]
    assert docs[0].context.endswith("Intro\nDécrète :") and docs[1].context == "Décision du 3.\n\nsans rien"
    flat = chunks.flatten(d).collect()
    assert [r.chunk_id for r in flat if r.type == "child"] == ["a_doc_0_art_0", "a_doc_0_art_1"]


def test_windows(spark):
    sizes = [0, 1, 3300, 3301, 3400, 6700]
    rows = windows.char_windows(spark.createDataFrame([(n, "x" * n) for n in sizes], "source int, text string")).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in rows} == {n: -(-n // 3300) for n in sizes if n}


def test_layout(spark):
    block = lambda n, x0, x1, y0, t, kind=0, page=1: ("s", page, 600.0, n, x0, y0, x1, 0.0, t, kind)
    rows = [block(0, 310.0, 500.0, 10.0, "right"), block(1, 50.0, 290.0, 10.0, "left"), block(2, 0.0, 500.0, 20.0, "wide"), block(3, 300.0, 500.0, 30.0, "mid"), block(4, 10.0, 200.0, 30.0, " DÉCRETS "), block(5, 10.0, 200.0, 40.0, "last"), block(6, 1.0, 2.0, 1.0, "image", 1)]
    rows += [block(0, 1.0, 2.0, 1.0, "cover", page=0), block(0, 1.0, 2.0, 1.0, "SOM", page=2), block(1, 1.0, 2.0, 1.0, "Sommaire", 1, page=3), block(0, 1.0, 2.0, 1.0, " ", page=4)]
    df = spark.createDataFrame(rows, "source string, page_no int, page_width double, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int")
    assert layout.reading_order(df).first().text == "left\nright\nwide\n\nmid\nlast\n\n\nSOM\n\n\n\n\n"


def test_fusion_ties_and_zero_weights(spark):
    ranked = spark.createDataFrame([(1, "vector", 1, "a"), (1, "keyword", 1, "b"), (1, "vector", 2, "c")], "query_id int, system string, rank int, chunk_id string")
    weights = spark.createDataFrame([("vector", 0.0)], "system string, weight double")
    assert [r.chunk_id for r in fusion.fuse(ranked, weights).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.chunk_id for r in fusion.fuse(ranked).orderBy("rank").collect()] == ["a", "b", "c"]


def test_judge(spark):
    answers = ["SCORE: 7", "score: 7.5", "SCORE: 85", "SCORE: -3", "none", None]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(evaluate.judge_score(F.col("a")).alias("s")).collect()
    assert [r.s for r in rows] == [7, 7, 85, 0, 0, 0]


def test_capitals_are_one_for_one(spark):
    """As DuckDB's upper has them: of all letters, alone and among others."""
    letters = [chr(i) for i in range(1, 0x3000) if not 0x1C80 <= i < 0x1C90] + [chr(i) for i in range(0xFB00, 0xFB50)]
    rows = [*letters, "straße ŉ ßß ﬁᾳ é", "", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, x string").coalesce(1)
    got = [r.u for r in frame.select("i", X.capitals("x").alias("u")).orderBy("i").collect()]
    assert got[-3:] == ["STRAẞE ŉ ẞẞ ﬁᾼ É", "", None]
    known = duckdb.execute("select upper(unnest(?::varchar[]))", [rows]).fetchall()
    assert [(a, b, c) for a, b, (c,) in zip(rows, got, known, strict=True) if b != c and a not in ("ƛ", "ɤ")] == []  # of Unicode 16


def test_collapse_every_white_character(spark):
    """Runs of all white space, single blanks left, whatever stands beside them."""
    rows = [f"a{x}b{x}{y}c{y} {x}d" for x in X.WHITE for y in " \n　​"] + [x.join("  é ") for x in "ᚁ ​⿿"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(rows)), "i int, x string").coalesce(1).select("i", X.collapse("x").alias("t")).orderBy("i").collect()]
    assert got == [re.sub(f"[{re.escape(X.WHITE)}]+", " ", x) for x in rows]
    assert "(?=" in X.ANY  # classes beyond U+00FF are slow


def test_headings_at_the_first_character(spark):
    """Of a text, and of a document's body."""
    text = "Décret exécutif n° 1 a. ----Article 1er. - un\nArt. 2. - deux"
    docs = spark.createDataFrame([("x", text)], "source string, text string")
    d = segment.segment(docs).first().documents[0]
    assert (d.title, d.articles) == ("Décret exécutif n° 1 a.", ["Article 1er. - un", "Art. 2. - deux"]) and d.context == "Décret exécutif n° 1 a.\n\n"
