"""The queries over the driver's tables. Inputs that these lack are written by expressions that DuckDB reads alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, calls, chunks, context, diagnostics, evaluate, fusion, layout, providers, search, segment, sizes, substring_index, vector, vector_index, windows
from ..sources import collection, files, io
from ..streaming import ingest
from . import golden

#: A gazette made around each document, with all headings and branches; the whole text is an article and a preamble. Plain SQL of both engines.
GAZETTE = """concat('Journal officiel', chr(10), 'Décret exécutif n° ', doc_id, ' du 3 mars', chr(10), 'portant ', replace(substr(text, 1, 60), '.', ' '), '. ----', chr(10),
 'Le Premier ministre,', chr(10), 'Vu le décret présidentiel n° 24-10 du 3 mars ;', chr(10), 'Décrète :', chr(10), 'Article 1er. — ', text, chr(10), 'Le Président', chr(10), 'Art. 2. — ', substr(text, 50, 150), chr(10), 'Fait à Alger, le 3 mars.', chr(10),
 'ARRÊTÉ du ', doc_id, ' avril fixant. _____', chr(10), text, chr(10), 'Art. 3. - ', substr(text, 10, 100), chr(10),
 'Décision n° ', doc_id, ' de la commission. ---', chr(10), substr(text, 5, 60), chr(10), 'Article 1er. - ', substr(text, 3, 90), chr(10),
 'Arrêté du 5 mai sans tirets', chr(10), 'Art. 9 - ', substr(text, 1, 50), '. ---', chr(10), 'perdu')"""
#: Dirty text around each document: line ends, blank lines, emoji, Arabic letters.
DIRTY = "concat(' ', chr(13), chr(10), substr(text, 1, 300), chr(10), chr(10), chr(10), '😀😁x سل y', chr(13), 'z  ', substr(text, 301), chr(10), ' ')"
#: A model's tagged answer: the whole text, title too short, content too short, without an end.
TAGGED = "concat('bla [[START]]', chr(10), 'ID: Décret n° ', doc_id, chr(10), 'CONTENT: ', text, chr(10), '[[END]] x [[START]] ID: court CONTENT: ', substr(text, 1, 50), ' [[END]] [[START]] ID: Décision longue CONTENT: 12345678901234567890 [[END]] [[START]] ID: Décision ', doc_id, ' CONTENT: ', substr(text, 20, 40), '123456789012345678901 [[END]] [[START]] ID: Décret sans fin CONTENT: rien')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def gazettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("source"), F.expr(GAZETTE).alias("text"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents laid out on pages by whole-number arithmetic."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "line"))
    return lines.selectExpr(
        "cast(doc_id as string) as source", "cast(pos div 9 as int) as page_no", "600.0D as page_width", "cast(pos % 9 as int) as block_no",
        "cast(case (doc_id + pos) % 4 when 0 then 50 when 1 then 310 when 2 then 300 else 40 end as double) as x0", "cast(((pos * 37 + doc_id * 11) % 5) * 50 as double) as y0",
        "cast(case (doc_id + pos) % 4 when 0 then 50 when 1 then 310 when 2 then 300 else 40 end + case when (doc_id * 7 + pos) % 11 = 0 then 500 when (doc_id + pos) % 7 = 0 then 450 else 200 end as double) as x1", "0.0D as y1",
        "case when (doc_id + pos) % 17 = 0 then '  DÉCRETS ' when (doc_id + pos) % 19 = 0 then '   ' when (doc_id * 3 + pos) % 61 = 0 then 'SOMMAIRE' else line end as text", "case when (pos + doc_id) % 13 = 0 then 1 else 0 end as block_type",
    )


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", X.normalize("text").alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


def text_cleaning(function: Callable[[str], object]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.expr(DIRTY).alias("d")).select("doc_id", function("d").alias("cleaned"))

    return query


def index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The documents' stored index. It is built when first asked for, and again when the table's files or the code that makes it are others."""
    path = f"{io.shared(spark)}/lutrin-bm25-{io.code(bm25, X)}-{io.fingerprint(spark, f'{sf_dir}/documents.parquet')}"
    return bm25.read(spark, io.once(spark, path, lambda made: bm25.build(corpus(spark, sf_dir), made)))


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index of all documents, built whenever this is asked, and its sizes."""
    own = bm25.build(corpus(spark, sf_dir), io.temporary(spark))
    sums = own.blocks.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("postings"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    return own.stats.select("n").join(F.broadcast(sums)).join(F.broadcast(own.vocabulary.agg(F.count("*").alias("terms"))))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25.search(index(spark, sf_dir), questions(spark, sf_dir))
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnosis: the five best whatever their score, and whether they have the wanted text."""
    asked = questions(spark, sf_dir)
    hits = sizes.bounded(bm25.search(index(spark, sf_dir), asked, k=5, positive=False), 5 * asked.count())
    rows = hits.join(corpus(spark, sf_dir), "chunk_id")
    return rows.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.col("document").contains("ing").alias("has_target"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    hits = vector.search(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir))
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_index_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of vector_top10 from a new index by cells, all of which are read."""
    index = vector_index.build(_vectors(spark, sf_dir), io.temporary(spark))
    hits = vector_index.search(index, _asked_vectors(spark, sf_dir), probes=vector_index.CELLS)
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"))


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs the exact search has, and whether the index finds 95 % of them in the cells that it reads by default."""
    asked = _asked_vectors(spark, sf_dir)
    index = vector_index.build(_vectors(spark, sf_dir), io.temporary(spark))
    exact = vector.search(_vectors(spark, sf_dir), asked).select("query_id", "chunk_id")
    found = vector_index.search(index, asked).select("query_id", "chunk_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(F.count("*").alias("pairs"), (F.count("found") >= 0.95 * F.count("*")).alias("recalled"))


def _taken_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


def bm25_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches an index that was built of the English documents, given the others, sent the French ones once more, and from which those
    labelled toxic were taken."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")), io.temporary(spark)
    bm25.build(docs.where("lang = 'en'"), path, "doc_id", "text")
    bm25.update(spark, path, docs.where("lang <> 'en'"), key="doc_id", text="text")
    bm25.update(spark, path, docs.where("lang = 'fr'"), key="doc_id", text="text")
    index = bm25.update(spark, path, removed=_taken_down(spark, sf_dir).select(F.col("doc_id").alias("chunk_id")))
    hits = bm25.search(index, questions(spark, sf_dir))
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def collection_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds of documents stored by versions: English ones, then the others, the French sent again in capitals, those labelled
    toxic withdrawn."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text"), io.temporary(spark)
    collection.replace(docs.where("lang = 'en'"), path, source="doc_id")
    collection.upsert(docs.where("lang <> 'en'"), path)
    collection.upsert(docs.where("lang = 'fr'").withColumn("text", X.capitals("text")), path)
    collection.upsert(docs.limit(0), path, sources=_taken_down(spark, sf_dir))
    rows = collection.read(spark, path)
    return rows.select("doc_id", "lang", F.substring("text", 1, 80).alias("begins"), F.length("text").cast("long").alias("n"))


def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions, each with the vector of its id, if there is one."""
    vectors = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).join(vectors, "query_id", "left")


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ranked lists of each benchmark text."""
    return search.retrieve(with_vectors(spark, sf_dir), index(spark, sf_dir), _vectors(spark, sf_dir))


def best(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The best k of each question; few, if the questions are."""
    return sizes.bounded(search.fused(retrieve(spark, sf_dir)).where(F.col("rank") <= k), k * questions(spark, sf_dir).count())


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = search.fused(retrieve(spark, sf_dir)).where("rank <= 3")
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _configured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The best three of each question under each of the six weightings, and the weightings' numbers."""
    weights = spark.createDataFrame([(i, s, w) for i, pair in enumerate(evaluate.WEIGHTINGS) for s, w in zip(("keyword", "vector"), pair, strict=True)], "config_id int, system string, weight double")
    top = fusion.fuse(retrieve(spark, sf_dir), weights).where("rank <= 3")
    return sizes.bounded(top, 3 * len(evaluate.WEIGHTINGS) * questions(spark, sf_dir).count()), weights.select("config_id").distinct()


def _metrics(out: DataFrame) -> DataFrame:
    return out.select(F.col("config_id").cast("long").alias("config_id"), F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and reciprocal rank of the six weightings; a document with the item's text in it is relevant."""
    top, configs = _configured(spark, sf_dir)
    return _metrics(evaluate.retrieval(questions(spark, sf_dir), top.join(corpus(spark, sf_dir), "chunk_id"), relevant=F.col("document").contains(F.col("query")), configs=configs))


def eval_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the usual rule: a chunk whose id contains the expected id is relevant."""
    top, configs = _configured(spark, sf_dir)
    golden = questions(spark, sf_dir).withColumn("expected_doc_id", (F.col("query_id") % 10).cast("string"))
    return _metrics(evaluate.retrieval(golden, top.withColumn("chunk_id", F.col("chunk_id").cast("string")), configs=configs))


JUDGED = "case conv_id % 5 when 0 then concat('SCORE: ', turn % 11) when 1 then concat('score: ', turn % 11, '.5') when 2 then concat('Score:', 85 + turn) when 3 then concat('SCORE: -', turn) else text end"


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(JUDGED).alias("answer")).select("conv_id", "turn", evaluate.judge_score("answer").alias("score"))


def judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.judged(table(spark, sf_dir, "conversations").select(F.expr(JUDGED).alias("answer")))
    return out.select(F.round("mean_score", 6).alias("mean_score"), "band")


def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.char_windows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text"))
    return out.select(F.col("source").alias("doc_id"), F.col("start").cast("long").alias("start"), "chunk")


def tagged_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tagged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.expr(TAGGED).alias("response")))
    return out.select(F.col("source").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "official_id", "text", "journal_date", "type")


def segment_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks.documents(segment.segment(gazettes(spark, sf_dir)))
    return docs.select("source_file", F.col("doc_idx").cast("long").alias("doc_idx"), "d.title", "d.context")


def segment_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks.documents(segment.segment(gazettes(spark, sf_dir)))
    each = docs.select("source_file", "doc_idx", F.posexplode("d.articles").alias("art_idx", "article"))
    return each.select("source_file", F.col("doc_idx").cast("long").alias("doc_idx"), F.col("art_idx").cast("long").alias("art_idx"), "article")


def chunk_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.flatten(segment.segment(gazettes(spark, sf_dir)))
    return out.select("chunk_id", "document", "source", "type", "title", "context", "parent_title", "parent_id", "original_article_text")


def layout_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(page_blocks(spark, sf_dir))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, every other with a title."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"), F.lit(None).cast("string").alias("parent_title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"))


def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.contexts(best(spark, sf_dir), _titled(spark, sf_dir))
    return context.prompts(questions(spark, sf_dir), found, "CONTEXTE:\n{context}\nQUESTION: {query}\n").select("query_id", "prompt")


def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From questions to answers, with the stand-in for a model."""
    return search.answers(questions(spark, sf_dir), best(spark, sf_dir), _titled(spark, sf_dir)).select("query_id", "prompt", "answer")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    answered = search.answers(asked, best(spark, sf_dir), _titled(spark, sf_dir), evaluation=True)
    return search.judged(asked.withColumn("expected_answer", F.substring("query", 1, 40)), answered)


def answer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer and its judge's score, with the stand-in for both models."""
    return _judged(spark, sf_dir).select("query_id", "answer", "score")


def answer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.judged(_judged(spark, sf_dir), "verdict")
    return out.select(F.round("mean_score", 6).alias("mean_score"), "band")


def embed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's vectors of the questions: their size and two of their numbers."""
    rows = providers.embed(questions(spark, sf_dir), text="query")
    number = lambda i: F.round(F.col("embedding")[i].cast("double"), 5)
    return rows.select("query_id", F.size("embedding").cast("long").alias("size"), number(0).alias("first"), number(63).alias("last"))


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all texts, each segmented by the stand-in for a model, and its tagged answers parsed."""
    cut = windows.char_windows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text"))
    said = providers.generate(context.fill(context.SEGMENT, chunk=F.col("chunk")), providers.stub_segmenter)
    return windows.tagged(cut.select(F.struct("source", "start").alias("source"), said.alias("response")))


def llm_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracts(spark, sf_dir)
    return out.select(F.col("source.source").alias("doc_id"), F.col("source.start").cast("long").alias("start"), "official_id", "text", "journal_date", "type")


def extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"))
    out = windows.extract_counts(texts, extracts(spark, sf_dir).withColumn("source", F.col("source.source")))
    return out.select(F.col("source").alias("doc_id"), "extracts")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.counts(chunks.flatten(segment.segment(gazettes(spark, sf_dir))))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(gazettes(spark, sf_dir)).select("source_file", F.col("total_documents").cast("long").alias("total_documents"))


def golden_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many golden questions each file answers, how many of them have an answer to compare with, and how many documents the first kind finds."""
    asked = golden.retrieval(spark)
    hits = bm25.search(index(spark, sf_dir), asked.select("query_id", "query")).groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = asked.join(hits, "query_id", "left").withColumn("answered", F.lit(0)).unionByName(golden.answers(spark).withColumn("answered", F.lit(1)).withColumn("hits", F.lit(0)).drop("expected_answer"))
    return rows.groupBy("expected_doc_id").agg(F.count_if(F.col("answered") == 0).alias("questions"), F.count_if(F.col("answered") == 1).alias("answers"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def golden_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden questions' words against the documents."""
    hits = bm25.search(index(spark, sf_dir), golden.retrieval(spark).select("query_id", "query"))
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.match_count(corpus(spark, sf_dir), "the")


def raw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.raw_search(corpus(spark, sf_dir), "the", "chunk_id")


def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.headers(gazettes(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def ocr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sentences as its recognised pages."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", r"\. ")).alias("pos", "text"))
    return layout.join_ocr_pages(pages.select("source", (F.col("pos") + 1).alias("page_no"), "text"))


def embedded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's vectors of all turns of conversations, each different text embedded once."""
    rows = providers.embed_each(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), text="text")
    number = lambda i: F.round(F.col("embedding")[i].cast("double"), 5)
    return rows.select("conv_id", "turn", F.size("embedding").cast("long").alias("size"), number(0).alias("first"), number(63).alias("last"))


def golden_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden questions answered from the documents that their words find, and what a judge makes of the expected answers beside them, with the
    stand-in for both models."""
    asked = golden.answers(spark)
    found = bm25.search(index(spark, sf_dir), asked.select("query_id", "query"), 3)
    answered = search.answers(asked.select("query_id", "query"), found, _titled(spark, sf_dir), evaluation=True)
    return search.judged(asked, answered).select("query_id", "answer", "score")


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with a file for each page."""
    path = f"{io.temporary(spark)}/pages"
    io.write_texts(table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("source"), F.col("html").alias("text")), path, named=True)
    return path


def written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files by name, and read back."""
    return io.read_texts(spark, _page_files(spark, sf_dir))


class Lines:
    """Files whose pages are their lines."""

    def count(self, content: bytes) -> int:
        return content.count(b"\n") + 1

    def rows(self, content: bytes, page: int) -> list[tuple]:
        return [(content.split(b"\n")[page].decode(),)]


def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of files as a source: of all files the second line and the third."""
    files.register(spark, files.page_source("lutrin_lines", "text string", Lines(), suffix=".txt"))
    rows = spark.read.format("lutrin_lines").load(_page_files(spark, sf_dir)).where("page_no between 1 and 2")
    return rows.select("source", F.col("page_no").cast("long").alias("page_no"), "text")


def ingested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken in as a stream, cleaned, into a collection; then once more from the start, which changes nothing."""
    folder, out, done = _page_files(spark, sf_dir), io.temporary(spark), io.temporary(spark)
    for _ in range(2):
        step = lambda df: df.select(F.col("source").alias("source_file"), X.clean("text").alias("cleaned"))
        ingest.ingest(spark, folder, out, f"{done}/log", step).awaitTermination()
    return collection.read(spark, out)


def substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw search by a new index of trigrams, of which only the rare ones' texts are read."""
    index = substring_index.build(corpus(spark, sf_dir), io.temporary(spark))
    return diagnostics.raw_search(substring_index.search(index, "tion on"), "tion on", "chunk_id")


def _failing() -> providers.Generate:
    """A stand-in for a model that can't answer questions."""

    def answer(prompts: list[str]) -> list[str]:
        if any("?" in p for p in prompts):
            raise ValueError("a question")
        return providers.stub_generator()(prompts)

    return answer


def remembered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as prompts, each different one asked once; then all of them again, which asks none."""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt")), io.temporary(spark)
    for _ in range(2):
        found = calls.ask(rows, path, "stand-in", _failing)
    return found.select("conv_id", "turn", "answer", "error")


def stub_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding and generation through the provider interface, with the deterministic stand-ins."""
    rows = providers.embed(corpus(spark, sf_dir))
    return rows.select("chunk_id", F.size("embedding").cast("long").alias("size"), evaluate.judge_score(providers.generate(F.col("document"))).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rrf_hybrid": rrf_hybrid, "tokenize_documents": tokenize_documents, "clean_text": text_cleaning(X.clean), "debug_clean": text_cleaning(X.plain), "remove_arabic": text_cleaning(X.remove_arabic), "collapse_ws": text_cleaning(X.collapse),
    "term_stats": term_stats, "corpus_stats": corpus_stats, "bm25_index": bm25_index, "bm25_top10": bm25_top10, "bm25_top5": bm25_top5, "vector_top10": vector_top10, "eval_hit_mrr": eval_hit_mrr, "eval_by_id": eval_by_id, "judge_parse": judge_parse, "judge_mean": judge_mean,
    "char_windows": char_windows, "tagged_parse": tagged_parse, "segment_titles": segment_titles, "segment_articles": segment_articles, "chunk_flatten": chunk_flatten, "layout_reading_order": layout_reading_order,
    "context_prompt": context_prompt, "raw_search": raw_search, "header_detect": header_detect, "incremental_skip": incremental_skip, "ocr_join": ocr_join, "stub_models": stub_models,
    "search_answers": search_answers, "answer_eval": answer_eval, "answer_mean": answer_mean, "embed_questions": embed_questions, "llm_segment": llm_segment, "extract_counts": extract_counts,
    "chunk_counts": chunk_counts, "source_counts": source_counts, "match_count": match_count, "golden_tables": golden_tables, "golden_search": golden_search,
    "vector_index_all": vector_index_all, "vector_index_recall": vector_index_recall, "bm25_upkeep": bm25_upkeep, "collection_upkeep": collection_upkeep,
    "written_pages": written_pages, "page_source": page_source, "ingested_pages": ingested_pages, "substring_hits": substring_hits, "remembered_calls": remembered_calls,
    "embedded_turns": embedded_turns, "golden_answers": golden_answers,
}
