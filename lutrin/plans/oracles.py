"""DuckDB SQL for the queries, written apart from them; the inputs' expressions are shared."""

from __future__ import annotations

from ..operators import context
from . import golden
from .queries import DIRTY, GAZETTE, JUDGED, TAGGED

W = r"[\s\x{00A0}\x1c-\x1f]"
PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '{W}+', ' ', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(lower({x}), '{PUNCTUATION}', ''), '{W}+'), lambda t: t <> '')"


ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]+"
TOKENS = f"tokens as materialized (select doc_id as chunk_id, {tokens('text')} as t from documents), dl as (select chunk_id, len(t) as dl, t from tokens), postings as materialized (select chunk_id, dl, term, count(*) as tf from (select chunk_id, dl, unnest(t) as term from dl) group by all)"
STATS = f"{TOKENS}, size as (select count(*) as n, avg(dl) as avgdl from dl), raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as idf0 from postings, size group by term), mean as (select avg(idf0) as avg_idf from raw), vocabulary as (select term, df, case when idf0 >= 0 then idf0 else 0.25 * avg_idf end as idf from raw, mean)"
GOLDEN = "(select * from (values " + ", ".join(f"({i}::bigint, '" + q.replace("'", "''") + "')" for i, (q, _) in enumerate(golden.RETRIEVAL)) + ") t(item_id, text))"

ANSWERS = "(select * from (values " + ", ".join("(" + f"{i}::bigint, " + ", ".join("'" + y.replace("'", "''") + "'" for y in (x[0], x[2])) + ")" for i, x in enumerate(golden.ANSWERS)) + ") t(item_id, text, expected))"


def bm25(asked: str) -> str:
    return f"""{STATS}, terms as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({tokens('text')}) as term from {asked}) group by all),
scores as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from postings join terms using (term) join vocabulary using (term), size group by all),
keyword as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scores where score > 0) where rank <= 10)"""


BM25 = bm25("benchmark")


def nearest(asked: str) -> str:
    distance = "round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double))), 6)"
    return f"vector as (select * from (select b.vec_id as query_id, a.vec_id as chunk_id, {distance} as distance, row_number() over (partition by b.vec_id order by {distance}, a.vec_id) as rank from embeddings a, embeddings b where {asked}) where rank <= 10)"


BOTH = f"{BM25}, {nearest('b.vec_id in (select item_id from benchmark)')}, ranked as (select query_id, 'vector' as system, 0 as o, rank, chunk_id from vector union all select query_id, 'keyword', 1, rank, chunk_id from keyword)"
FUSED = f"{BOTH}, fused as (select query_id, chunk_id, round(sum((case system when 'keyword' then 0.7 else 0.3 end)::double / (60 + rank)), 12) as score, min(o * 1000 + rank) as first from ranked group by all), top as (select *, row_number() over (partition by query_id order by score desc, first) as rank from fused)"

TITLE = rf"(?is)(?:^|\n)((?:Décret{W}+(?:présidentiel|exécutif)|Arrêté(?:{W}+interministériel)?|Décision){W}+(?:n[°o\.]?|du).*?\.){W}*[-—–_]{{3,}}"
ARTICLE = rf"(?i)((?:^|\n){W}*Art(?:icle)?\.?{W}*\d+(?:er)?\.?{W}*[-—–]+)"
FIRST = rf"(?i)((?:^|\n){W}*Art(?:icle)?\.?{W}*1?(?:er)?\.?{W}*[-—–]+)"
ENACTS = rf"(?i)((?:^|\n){W}*(?:Décrète|Décrètent|Décide|Décident|Arrête|Arrêtent){W}*:{W}*(?:\n|$))"
SECTIONS = rf"""gazette as (select concat('F', doc_id) as source_file, {GAZETTE} as text from documents),
parts as (select source_file, unnest(string_split(regexp_replace(text, '{TITLE}', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]) as x, generate_subscripts(string_split(regexp_replace(text, '{TITLE}', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:], 1) as i from gazette),
cut as (select source_file, i, {collapse(strip("string_split(x, chr(2))[1]"))} as title, {strip("string_split(x, chr(2))[2]")} as body from parts),
docs as (select source_file, row_number() over (partition by source_file order by i) - 1 as doc_idx, title, body from cut where not (contains(title, 'Article') or contains(title, 'Art.') or contains(title, 'Chapitre'))),
context as (select source_file, doc_idx, title, body, title || chr(10) || chr(10) || {strip(rf"case when regexp_matches(body, '{ENACTS}') then string_split(regexp_replace(body, '{ENACTS}', '\1' || chr(1), 'g'), chr(1))[1] when regexp_matches(body, '{FIRST}') then string_split(regexp_replace(body, '{FIRST}', chr(1) || '\1', 'g'), chr(1))[1] else body end")} as context from docs),
arts as (select source_file, doc_idx, unnest(l) as x, generate_subscripts(l, 1) as i, len(l) as n from (select source_file, doc_idx, string_split(regexp_replace(body, '{ARTICLE}', chr(1) || '\1', 'g'), chr(1))[2:] as l from docs)),
ended as (select source_file, doc_idx, i, {strip(collapse("case when i = n and e < 1000000 then substr(x, 1, e - 1) else x end"))} as article from (select *, least(case when instr(x, 'Fait à Alger') > 0 then instr(x, 'Fait à Alger') else 1000000 end, case when instr(x, 'Fait à ') > 0 then instr(x, 'Fait à ') else 1000000 end, case when instr(x, 'Le Premier ministre') > 0 then instr(x, 'Le Premier ministre') else 1000000 end, case when instr(x, 'Le Président') > 0 then instr(x, 'Le Président') else 1000000 end) as e from arts)),
articles as (select source_file, doc_idx, row_number() over (partition by source_file, doc_idx order by i) - 1 as art_idx, article from ended where article <> '')"""

X0 = "case (doc_id + pos) % 4 when 0 then 50 when 1 then 310 when 2 then 300 else 40 end"
LAYOUT = rf"""lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos from (select doc_id, string_split(text, '. ') as l from documents)),
blocks as (select doc_id, pos // 9 as page_no, pos % 9 as block_no, {X0} as x0, ((pos * 37 + doc_id * 11) % 5) * 50 as y0, {X0} + case when (doc_id * 7 + pos) % 11 = 0 then 500 when (doc_id + pos) % 7 = 0 then 450 else 200 end as x1,
 case when (doc_id + pos) % 17 = 0 then '  DÉCRETS ' when (doc_id + pos) % 19 = 0 then '   ' when (doc_id * 3 + pos) % 61 = 0 then 'SOMMAIRE' else line end as text, case when (pos + doc_id) % 13 = 0 then 1 else 0 end as block_type from lines),
contents as (select doc_id, page_no from blocks where block_no < 5 group by all having contains(lower(string_agg(text, ' ' order by block_no)), 'sommaire')),
kept as (select b.* from blocks b anti join contents c on b.doc_id = c.doc_id and b.page_no = c.page_no where b.page_no > 0),
shown as (select *, {strip('text')} as t, {collapse('lower(' + strip('text') + ')')} = 'décrets' as ign from kept where block_type = 0 and {strip('text')} <> ''),
sep as (select *, (ign or x1 - x0 > 450) as sep from shown),
band as (select *, sum(sep::int) over (partition by doc_id, page_no order by y0, block_no rows unbounded preceding) as band, case when sep then -1 when x0 < 300 then 0 else 1 end as col from sep),
page as (select doc_id, page_no, string_agg(case when ign then '' when sep then t || chr(10) || chr(10) else t || chr(10) end, '' order by band, col, y0, block_no) as t from band group by all),
pages as (select distinct doc_id, page_no from kept)
select doc_id::varchar as source, string_agg(coalesce(regexp_replace(page.t, '{ARABIC}', '', 'g'), '') || chr(10) || chr(10), '' order by page_no) as text from pages left join page using (doc_id, page_no) group by doc_id"""

CONFIGS = "configs as (select * from (values (0, 1.0::double, 1.0::double), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 0.8, 0.2), (4, 0.6, 0.4), (5, 0.2, 0.8)) t(config_id, k, v))"
HEADER = r"(?i)((?:Décret\s+(?:présidentiel|exécutif)|Arrêté|Décision)\s+(?:n[°o\.]?)?\s*(?:\d+[-‐‑]\d+|\d{1,4}\b))"
SCORE = rf"coalesce(try_cast(nullif(regexp_extract({JUDGED}, '(?i)SCORE:\s*(\d+)', 1), '') as bigint), 0)"



def plain(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '\n+', chr(10), 'g'), '[\x{{10000}}-\x{{10FFFF}}]+', ' ', 'g')")


def filled(template: str, **values: str) -> str:
    """A prompt's template as an SQL expression."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += ["'" + before.replace("'", "''") + "'", values[name]]
    return " || ".join([*out, "'" + rest.replace("'", "''") + "'"])


def found(item: str, separator: str) -> str:
    return f"found as (select query_id, string_agg({item}, {separator} order by rank) as context from top join documents on doc_id = chunk_id where rank <= 3 group by query_id)"


TITLED = found("concat('DOCUMENT ', rank, ' (Source: ', case when doc_id % 2 = 0 then source else 'Document sans titre' end, ')', chr(10), 'CONTENU: ', text)", "chr(10) || chr(10) || '---' || chr(10) || chr(10)")
SHORT = found("concat('--- DOCUMENT ', rank, ' ---', chr(10), text)", "chr(10) || chr(10)")
QUOTED = {name: "'" + getattr(context, name).replace("'", "''") + "'" for name in ("NOTHING_FOUND", "NOT_IN_CONTEXT")}
SCORED = f"""{FUSED}, {SHORT}, asked as (select item_id as query_id, text as query, {filled(context.ANSWER, context="context", query="text")} as prompt from benchmark left join found on query_id = item_id),
answered as (select query_id, query, coalesce('SCORE: ' || (length(prompt) % 11), {QUOTED["NOT_IN_CONTEXT"]}) as answer from asked),
judged as (select query_id, answer, (length({filled(context.JUDGE, query="query", expected="substr(query, 1, 40)", answer="answer")}) % 11)::bigint as score from answered)"""
STUB = "list_transform(range(1, 128, 2), lambda i: (instr('0123456789abcdef', h[i]) - 1) * 16 + instr('0123456789abcdef', h[i + 1]) - 1 - 127.5::double)"
WINDOWS = "(select doc_id, start, substr(text, start + 1, 3500) as chunk from (select doc_id, text, unnest(range(0, length(text), 3300)) as start from documents))"
EXTRACTS = f"(select doc_id, start, concat('Décret de ', length(chunk), ' signes') as official_id, {strip('chunk')} as text from {WINDOWS}) where length(text) > 20"

LIVING = "living as (select * from documents anti join (select doc_id from labels where toxic = 1) using (doc_id))"

ORACLE_SQL: dict[str, str] = {
    "written_pages": "select concat(page_id, '.txt') as source, html as text from pages",
    "page_source": "select concat(page_id, '.txt') as source, i::bigint as page_no, l[i + 1] as text from (select page_id, string_split(html, chr(10)) as l, unnest([1, 2]) as i from pages) where i < len(l)",
    "ingested_pages": rf"select concat(page_id, '.txt') as source_file, {strip(rf"regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '\n+', chr(10), 'g'), '[\x{{10000}}-\x{{10FFFF}}]+', ' ', 'g')")} as cleaned from pages",
    "substring_hits": "select doc_id as chunk_id, substr(text, 1, 150) as excerpt from documents where contains(text, 'tion on')",
    "remembered_calls": "select conv_id, turn, case when contains(text, '?') then null else concat('SCORE: ', length(text) % 11) end as answer, case when contains(text, '?') then 'ValueError: a question' end as error from conversations",
    "vector_index_all": f"with {nearest('b.vec_id % 100 = 0')} select * from vector",
    "vector_index_recall": "select ((select count(*) from embeddings where vec_id % 100 = 0) * least(10, count(*)))::bigint as pairs, true as recalled from embeddings",
    "bm25_upkeep": f"with {LIVING}, {BM25.replace('from documents', 'from living')} select query_id, chunk_id, score, rank from keyword",
    "collection_upkeep": f"with {LIVING} select doc_id, lang, substr(t, 1, 80) as begins, length(t) as n from (select doc_id, coalesce(lang, '') as lang, case when lang = 'fr' then upper(text) else text end as t from living)",
    "tokenize_documents": f"select doc_id, len(t)::bigint as n, array_to_string(t, ' ') as tokens from (select doc_id, {tokens('text')} as t from documents)",
    "clean_text": rf"select doc_id, {strip(rf"regexp_replace(regexp_replace(regexp_replace({DIRTY}, '\r\n?', chr(10), 'g'), '\n+', chr(10), 'g'), '[\x{{10000}}-\x{{10FFFF}}]+', ' ', 'g')")} as cleaned from documents",
    "debug_clean": f"select doc_id, {plain(DIRTY)} as cleaned from documents",
    "remove_arabic": f"select doc_id, regexp_replace({DIRTY}, '{ARABIC}', '', 'g') as cleaned from documents",
    "collapse_ws": f"select doc_id, {collapse(DIRTY)} as cleaned from documents",
    "term_stats": f"with {STATS} select term, df, round(idf, 6) as idf from vocabulary",
    "corpus_stats": f"with {STATS} select n, round(avgdl, 6) as avgdl, round(avg_idf, 6) as avg_idf from size, mean",
    "bm25_index": f"with {STATS} select (select n from size) as n, count(*)::bigint as postings, sum(tf)::bigint as tokens, (select count(*) from vocabulary) as terms from postings",
    "bm25_top5": f"with {BM25}, five as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scores) select query_id, chunk_id, score, rank, contains(text, 'ing') as has_target from five join documents on doc_id = chunk_id where rank <= 5",
    "bm25_top10": f"with {BM25} select query_id, chunk_id, score, rank from keyword",
    "vector_top10": f"with {nearest('b.vec_id % 100 = 0')} select * from vector",
    "rrf_hybrid": f"with {FUSED} select query_id, chunk_id, round(score, 9) as score, rank from top where rank <= 3",
    "eval_hit_mrr": f"""with {BOTH}, {CONFIGS}, fused as (select config_id, query_id, chunk_id, round(sum(case system when 'keyword' then k else v end / (60 + rank)), 12) as score, min(o * 1000 + rank) as first from ranked, configs group by all),
top as (select *, row_number() over (partition by config_id, query_id order by score desc, first) as rank from fused), found as (select config_id, query_id, min(rank) as r from top join documents on doc_id = chunk_id join benchmark on item_id = query_id where rank <= 3 and contains(documents.text, benchmark.text) group by all)
select c.config_id::bigint as config_id, round(avg(case when r is null then 0.0 else 1.0 end) * 100, 6) as hit_rate, round(avg(coalesce(1.0::double / r, 0)), 6) as mrr from (select config_id, item_id from configs cross join benchmark) c left join found f on f.config_id = c.config_id and f.query_id = c.item_id group by c.config_id""",
    "eval_by_id": f"""with {BOTH}, {CONFIGS}, fused as (select config_id, query_id, chunk_id, round(sum(case system when 'keyword' then k else v end / (60 + rank)), 12) as score, min(o * 1000 + rank) as first from ranked, configs group by all),
top as (select *, row_number() over (partition by config_id, query_id order by score desc, first) as rank from fused), found as (select config_id, query_id, min(rank) as r from top where rank <= 3 and contains(chunk_id::varchar, (query_id % 10)::varchar) group by all)
select c.config_id::bigint as config_id, round(avg(case when r is null then 0.0 else 1.0 end) * 100, 6) as hit_rate, round(avg(coalesce(1.0::double / r, 0)), 6) as mrr from (select config_id, item_id from configs cross join benchmark) c left join found f on f.config_id = c.config_id and f.query_id = c.item_id group by c.config_id""",
    "judge_parse": f"select conv_id, turn, {SCORE} as score from conversations",
    "judge_mean": f"select round(m, 6) as mean_score, case when m >= 8.5 then 'excellent' when m >= 7 then 'good' else 'average' end as band from (select avg({SCORE}) as m from conversations)",
    "char_windows": "select doc_id, start, substr(text, start + 1, 3500) as chunk from (select doc_id, text, unnest(range(0, length(text), 3300)) as start from documents)",
    "tagged_parse": rf"""with found as (select doc_id, regexp_extract_all(r, '{(p := r"(?s)\[\[START\]\]\s*ID:\s*(.*?)\s*CONTENT:\s*(.*?)\s*\[\[END\]\]")}', 1) as a, regexp_extract_all(r, '{p}', 2) as b from (select doc_id, {TAGGED} as r from documents)),
each as (select doc_id, unnest(a) as a, unnest(b) as b, generate_subscripts(a, 1) - 1 as pos from found), cut as (select doc_id, pos, {strip('a')} as official_id, {strip('b')} as text from each)
select doc_id, pos::bigint as pos, official_id, text, 'Inconnue' as journal_date, case when contains(official_id, 'Décret') then 'Decret' else 'Arrêté' end as type from cut where length(official_id) > 5 and length(text) > 20""",
    "segment_titles": f"with {SECTIONS} select source_file, doc_idx, title, context from context",
    "segment_articles": f"with {SECTIONS} select source_file, doc_idx, art_idx, article from articles",
    "chunk_flatten": f"""with {SECTIONS} select concat(source_file, '_doc_', doc_idx) as chunk_id, concat('Titre: ', title, chr(10), 'Préambule: ', context) as document, source_file as source, 'parent' as type, title, context, null::varchar as parent_title, null::varchar as parent_id, null::varchar as original_article_text from context
union all select concat(source_file, '_doc_', doc_idx, '_art_', art_idx), concat('Source: ', title, chr(10), 'Contenu: ', article), source_file, 'child', null, null, title, concat(source_file, '_doc_', doc_idx), article from articles join context using (source_file, doc_idx)""",
    "layout_reading_order": f"with {LAYOUT}",
    "context_prompt": f"""with {FUSED}, {TITLED}
select item_id as query_id, 'CONTEXTE:' || chr(10) || context || chr(10) || 'QUESTION: ' || text || chr(10) as prompt from benchmark left join found on query_id = item_id""",
    "raw_search": "select doc_id as chunk_id, substr(text, 1, 150) as excerpt from documents where contains(text, 'the')",
    "header_detect": rf"""with g as (select concat('F', doc_id) as source, string_split(regexp_replace({plain(GAZETTE)}, '{HEADER}', chr(1) || '\1' || chr(2), 'g'), chr(1)) as p from documents),
each as (select source, unnest(range(1, len(p))) as i, p from g), cut as (select source, i - 1 as pos, string_split(p[i + 1], chr(2))[1] as header, replace(array_to_string(p[1:i], ''), chr(2), '') as ahead from each),
seen as (select source, pos, header, {strip("replace(lower(substr(ahead, greatest(1, length(ahead) - 49), 50)), chr(10), ' ')")} as before from cut)
select source, pos, header, before, contains(before, 'vu le') or contains(before, 'vu l''') or contains(before, 'application du') as is_visa, contains(header, '24-10') as has_target from seen""",
    "incremental_skip": "select doc_id, source from documents anti join labels using (doc_id)",
    "ocr_join": "select doc_id::varchar as source, string_agg(concat('--- Page ', page_no, ' ---', chr(10), t, chr(10), chr(10), repeat('=', 50), chr(10)), chr(10) order by page_no) as text from (select doc_id, unnest(l) as t, generate_subscripts(l, 1) as page_no from (select doc_id, string_split(text, '. ') as l from documents)) where page_no >= 2 group by doc_id",
    "stub_models": "select doc_id as chunk_id, 64::bigint as size, (length(text) % 11)::bigint as score from documents",
    "search_answers": f"with {FUSED}, {TITLED}, asked as (select item_id as query_id, {filled(context.ANSWER, context='context', query='text')} as prompt from benchmark left join found on query_id = item_id) select query_id, prompt, coalesce('SCORE: ' || (length(prompt) % 11), {QUOTED['NOTHING_FOUND']}) as answer from asked",
    "answer_eval": f"with {SCORED} select query_id, answer, score from judged",
    "answer_mean": f"with {SCORED} select round(m, 6) as mean_score, case when m >= 8.5 then 'excellent' when m >= 7 then 'good' else 'average' end as band from (select avg(score) as m from judged)",
    "embed_questions": f"select item_id as query_id, len(v)::bigint as size, round(v[1] / n, 5) as first, round(v[64] / n, 5) as last from (select item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from (select item_id, {STUB} as v from (select item_id, sha256('0|' || text) || sha256('1|' || text) as h from benchmark)))",
    "llm_segment": f"select doc_id, start, official_id, text, 'Inconnue' as journal_date, 'Decret' as type from {EXTRACTS}",
    "extract_counts": f"select doc_id, coalesce(n, 0)::bigint as extracts from documents left join (select doc_id, count(*) as n from {EXTRACTS} group by doc_id) using (doc_id)",
    "chunk_counts": f"with {SECTIONS} select 'parent' as type, count(*) as chunks from context having count(*) > 0 union all select 'child', count(*) from articles having count(*) > 0",
    "source_counts": f"with {SECTIONS} select source_file, coalesce(n, 0)::bigint as total_documents from gazette left join (select source_file, count(*) as n from docs group by source_file) using (source_file)",
    "golden_tables": f"""with {bm25(GOLDEN)}, files as (select * from (values {', '.join(f"({i}::bigint, '{x[1]}')" for i, x in enumerate(golden.RETRIEVAL))}) t(query_id, expected_doc_id)),
found as (select expected_doc_id, count(chunk_id) as hits from files left join keyword using (query_id) group by 1)
select expected_doc_id, questions, answers, hits::bigint as hits from (values ('F2025010.json', 5::bigint, 6::bigint), ('F2025009.json', 4, 6), ('F2025008.json', 4, 0), ('F2025007.json', 5, 6), ('F2025006.json', 4, 0), ('F2025005.json', 3, 0)) t(expected_doc_id, questions, answers) join found using (expected_doc_id)""",
    "golden_answers": f"""with {bm25(ANSWERS)}, top as (select * from keyword where rank <= 3), {SHORT}, golden as {ANSWERS},
asked as (select item_id as query_id, text as query, expected, {filled(context.ANSWER, context="context", query="text")} as prompt from golden left join found on query_id = item_id),
answered as (select query_id, query, expected, coalesce('SCORE: ' || (length(prompt) % 11), {QUOTED["NOT_IN_CONTEXT"]}) as answer from asked)
select query_id, answer, (length({filled(context.JUDGE, query="query", expected="expected", answer="answer")}) % 11)::bigint as score from answered""",
    "embedded_turns": f"select conv_id, turn, len(v)::bigint as size, round(v[1] / n, 5) as first, round(v[64] / n, 5) as last from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from (select conv_id, turn, {STUB} as v from (select conv_id, turn, sha256('0|' || t) || sha256('1|' || t) as h from (select *, coalesce(text, '') as t from conversations))))",
    "golden_search": f"with {bm25(GOLDEN)} select query_id, chunk_id, score, rank from keyword",
    "match_count": "select count(*) filter (where contains(text, 'the')) as matches from documents",
}
