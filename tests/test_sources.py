"""Readers, writers and the incremental intake, on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from lutrin.operators import bm25, chunks, evaluate, search, segment, vector, windows
from lutrin.sources import collection, io
from lutrin.streaming import ingest

PDF = b"%PDF-1.4 not really"


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name.replace("_dot_", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_pdf_pages_and_errors(spark, tmp_path):
    def reader(content):
        if content == b"broken":
            raise ValueError("no pages")
        return [(i, 600.0, 0, 1.0, 2.0, 3.0, 4.0, f"page {i} of {len(content)}", 0) for i in range(2)]

    path = put(tmp_path / "pdfs", a_dot_pdf=PDF, B_dot_PDF=PDF + b"x", c_dot_txt="no", d_dot_Pdf=b"broken")
    pdfs = io.read_pdfs(spark, path)
    assert sorted(r.source for r in pdfs.collect()) == ["B.PDF", "a.pdf", "d.Pdf"]
    read = io.read_pages(pdfs, reader)
    got = sorted((r.source, r.page_no, r.text) for r in io.pages(read).collect())
    assert got == [("B.PDF", i, f"page {i} of 20") for i in range(2)] + [("a.pdf", i, f"page {i} of 19") for i in range(2)]
    assert [tuple(r) for r in io.errors(read).collect()] == [("d.Pdf", "ValueError: no pages")]
    names = spark.createDataFrame([(x,) for x in ("a.pdf", "B.PDF", "d.Pdf", "x.pdf.json", "y")], "n string")
    assert [r.t for r in names.select(io.text_name(F.col("n")).alias("t")).collect()] == ["a.txt", "B.txt", "d.txt", "x.pdf.json", "y"]
    assert [r.t for r in names.select(io.json_name(F.col("n")).alias("t")).collect()] == ["a.json", "B.json", "d.json", "x.pdf.json", "y.json"]


def test_recognised_pages(spark, tmp_path):
    told = []

    def ocr(content, first_page, dpi, language):
        return [(i, f"{first_page} {dpi} {language} {i}") for i in range(1, 4)]

    pdfs = io.read_pdfs(spark, put(tmp_path / "pdfs", a_dot_pdf=PDF))
    rows = io.pages(io.recognise(pdfs, ocr)).orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in rows] == [(2, "2 300 fra 2"), (3, "2 300 fra 3")] and not told
    assert io.pages(io.recognise(pdfs, ocr, first_page=3, dpi=100)).first().text == "3 100 fra 3"


def test_texts(spark, tmp_path):
    path = put(tmp_path / "txt", a_dot_txt="un\r\ndeux\n", b_dot_TXT="é", c_dot_md="x", empty_dot_txt="")
    got = {r.source: r.text for r in io.read_texts(spark, path).collect()}
    assert got["a.txt"] == "un\r\ndeux\n" and got["b.TXT"] == "é" and "c.md" not in got
    assert "b.TXT" not in {r.source for r in io.read_texts(spark, path, any_case=False).collect()}
    assert io.read_texts(spark, f"{path}/a.txt").first().source == "a.txt"
    assert io.read_texts(spark, f"{path}/missing.txt").count() == 0
    texts = io.read_texts(spark, path).where("text <> ''")
    io.write_texts(texts, f"{tmp_path}/out")
    io.write_texts(texts, f"{tmp_path}/out")
    assert {r.source: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {k: v for k, v in got.items() if v}
    for _ in range(2):
        io.write_texts(texts.withColumn("source", F.regexp_replace("source", r"\.txt$", ".pdf")), f"{tmp_path}/files", named=True)
    assert {x.name: x.read_bytes().decode() for x in (tmp_path / "files").iterdir()} == {k: v for k, v in got.items() if v}


def test_gazettes(spark, tmp_path):
    whole = {"source_file": "a.json", "total_documents": 1, "documents": [{"title": "Décret", "articles": ["un"], "context": "Décret\n\nx"}]}
    path = put(tmp_path / "json", a_dot_json=json.dumps(whole, indent=1), b_dot_json='{"other": 1}', c_dot_JSON="{}", d_dot_json='{"documents": []}')
    rows = io.read_gazette(spark, path)
    assert sorted((r.source_file, len(r.documents)) for r in rows.collect()) == [("a.json", 1), ("d.json", 0)]
    io.write_json(rows, f"{tmp_path}/out")
    assert spark.read.schema(io.GAZETTE).json(f"{tmp_path}/out").where("source_file = 'a.json'").first().documents[0].articles == ["un"]
    io.write_json(rows, f"{tmp_path}/named", name="source_file")
    assert {x.name for x in (tmp_path / "named").iterdir()} == {"a.json", "d.json"} and json.loads((tmp_path / "named" / "a.json").read_text()) == whole
    assert sorted((r.source_file, len(r.documents)) for r in io.read_gazette(spark, f"{tmp_path}/named").collect()) == [("a.json", 1), ("d.json", 0)]
    flat = chunks.flatten(rows)
    assert io.read_chunks(spark, f"{tmp_path}/chunks") is None
    for _ in range(2):  # replaced, not added to
        io.write_chunks(flat, f"{tmp_path}/chunks")
    back = io.read_chunks(spark, f"{tmp_path}/chunks")
    assert {(r.type, r.chunks) for r in chunks.counts(back).collect()} == {("parent", 1), ("child", 1)}
    assert "chunk_id" not in back.select("title")._jdf.queryExecution().executedPlan().toString()


def test_golden(spark, tmp_path):
    path = put(tmp_path / "golden", g_dot_json='{"query": "Qui ?", "expected_doc_id": "F1.json"}\n{"query": "Quoi ?", "expected_doc_id": "F2.json", "expected_answer": "Ceci."}\n{"expected_doc_id": "F3.json"}')
    rows = {r.query: r for r in io.read_golden(spark, path).collect()}
    assert rows.keys() == {"Qui ?", "Quoi ?"} and rows["Quoi ?"].expected_answer == "Ceci." and rows["Qui ?"].query_id != rows["Quoi ?"].query_id


def test_intake_of_new_files(spark, tmp_path):
    path = put(tmp_path / "in", a_dot_txt="Décision n° 1 du jour. ---\nArt. 1er. - un", x_dot_md="no")
    run = lambda: ingest.ingest(spark, path, f"{tmp_path}/out", f"{tmp_path}/done", segment.segment).awaitTermination()
    run()
    run()
    put(tmp_path / "in", b_dot_txt="rien")
    run()
    assert sorted((r.source_file, r.total_documents) for r in collection.read(spark, f"{tmp_path}/out").collect()) == [("a.txt", 1), ("b.txt", 0)]


def test_intake_of_many_files_makes_few_tasks(spark, tmp_path):
    """Neither looking files up nor reading them takes a task a file, in the first run and in one that finds nothing new; the caller's settings stay."""
    path, n = put(tmp_path / "in", **{f"{i}_dot_txt": f"{i}\r\né" for i in range(600)}), 600
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        for _ in range(2):
            query = ingest.ingest(spark, path, f"{tmp_path}/out", f"{tmp_path}/done", lambda df: df.withColumnRenamed("source", "source_file"))
            query.awaitTermination()
            known = spark.sparkContext.statusTracker()
            stages = [known.getStageInfo(x) for job in known.getJobIdsForGroup(str(query.runId)) for x in known.getJobInfo(job).stageIds]
            assert 0 < sum(x.numTasks for x in stages if x) < n / 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held["spark.sql.files.maxPartitionBytes"])
    assert {k: spark.conf.get(k) for k in held} == held
    assert sorted(map(tuple, collection.read(spark, f"{tmp_path}/out").select("source_file", "text").collect())) == sorted((f"{i}.txt", f"{i}\r\né") for i in range(n))


def test_stored_once(spark, tmp_path):
    made = []

    def write(path):
        made.append(path)
        spark.range(3).write.parquet(path)

    for _ in range(2):
        assert spark.read.parquet(io.once(spark, f"{tmp_path}/t", write)).count() == 3
    assert len(made) == 1 and not (tmp_path / made[0].rpartition("/")[2]).exists()
    before = io.fingerprint(spark, f"{tmp_path}/t")
    (tmp_path / "t" / "more").write_text("x")
    assert io.fingerprint(spark, f"{tmp_path}/t") != before


def test_index_of_odd_corpora(spark, tmp_path):
    """No rows, rows without words, null texts; a question without words and one of unknown words."""
    asked = spark.createDataFrame([(1, "le texte"), (2, ""), (3, "zzz"), (4, None)], "query_id int, query string")
    none = bm25.build(spark.createDataFrame([], "chunk_id long, document string"), f"{tmp_path}/none")
    assert none.stats.first().n == 0 and bm25.search(none, asked).count() == 0
    rows = [(1, "le texte"), (2, ""), (3, None), (4, "le le autre"), (5, "autre chose")]
    index = bm25.build(spark.createDataFrame(rows, "chunk_id long, document string"), f"{tmp_path}/some")
    assert index.stats.first().n == 5 and abs(index.stats.first().avgdl - 7 / 5) < 1e-12
    assert {r.term: r.df for r in index.vocabulary.collect()} == {"le": 2, "texte": 1, "autre": 2, "chose": 1}
    assert [(r.query_id, r.chunk_id) for r in bm25.search(index, asked).orderBy("rank").collect()] == [(1, 1), (1, 4)]
    assert "In(term, [le,texte])" in bm25.search(index, asked)._jdf.queryExecution().executedPlan().toString().replace("texte,le", "le,texte")
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)) + " le")], "query_id int, query string")
    rows = spark.createDataFrame([(i, f"w{i} le") for i in range(20)], "chunk_id long, document string")
    assert bm25.search(bm25.build(rows, f"{tmp_path}/many"), many).count() == 10


def test_answers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "le texte"), ("b", "autre chose")], "chunk_id string, document string").withColumn("title", F.lit("T")).withColumn("parent_title", F.lit(None).cast("string"))
    index = bm25.build(rows, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "texte", [1.0, 0.0]), (2, "zzz", None)], "query_id int, query string, vector array<float>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    best = search.fused(search.retrieve(asked, index, vectors))
    got = {r.query_id: r for r in search.answers(asked, best, rows).collect()}
    assert "DOCUMENT 1 (Source: T)\nCONTENU: le texte" in got[1].prompt and got[1].answer == f"SCORE: {len(got[1].prompt) % 11}"
    assert got[2].prompt is None and got[2].answer.startswith("Désolé")

    def broken():
        def fail(prompts):
            raise RuntimeError

        return fail

    assert {r.answer for r in search.answers(asked, best, rows, broken).collect()} >= {""}
    judged = search.judged(asked.withColumn("expected_answer", F.lit(None).cast("string")), search.answers(asked, best, rows, evaluation=True))
    assert sorted(r.query_id for r in judged.collect()) == [1, 2] and all(r.verdict == f"SCORE: {r.score}" for r in judged.collect())
    # Questions without vectors are embedded.
    own = search.retrieve(asked.select("query_id", "query"), index, vectors.withColumn("embedding", F.array_repeat(F.lit(0.1).cast("float"), 64)))
    assert own.where("system = 'vector'").count() == 4


def test_limits(spark):
    with pytest.raises(ValueError):
        windows.char_windows(spark.createDataFrame([("a", "b")], "source string, text string"), 10, 10)
    scores = spark.createDataFrame([("SCORE: 12345678901",), ("SCORE: 99999999999999999999999",)], "a string").select(evaluate.judge_score("a").alias("s"))
    assert [r.s for r in scores.collect()] == [12345678901, 0]


def test_nearest_against_all_pairs(spark, monkeypatch):
    """Ties, nulls, vectors of another length, repeated rows, fewer rows than asked for; queries broadcast and dealt."""
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [1.0, None])]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [9.0, 0.5]), ("c", None)], "query_id string, vector array<float>")
    want = set()
    for q, v in (("a", [1.0, 1.0]), ("b", [9.0, 0.5])):
        order = sorted((round((x[0] - v[0]) ** 2 + (x[1] - v[1]) ** 2, 6), i) for i, x in rows[:50])
        want |= {(q, i, d, r + 1) for r, (d, i) in enumerate(order[:10])}
    for most, part in ((2_000_000, 4_000_000), (0, 4_000_000), (0, 20)):  # broadcast, dealt, dealt to several parts
        monkeypatch.setattr(vector, "BROADCAST_NUMBERS", most)
        monkeypatch.setattr(vector, "PART_NUMBERS", part)
        assert {tuple(r) for r in vector.search(corpus, asked).collect()} == want
        assert vector.search(corpus, asked, k=80).count() == 100
        # The first query's length decides nothing for the others.
        odd = spark.createDataFrame([("0", [1.0])], asked.schema).union(asked)
        assert {tuple(r) for r in vector.search(corpus, odd).collect()} == want | {("0", 51, 0.0, 1)}
    monkeypatch.undo()
    assert vector.search(corpus.limit(0), asked).count() == 0 and vector.search(corpus, asked.limit(0)).count() == 0
