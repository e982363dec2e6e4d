"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, license_scan, lm, merkle, pii, quality, runs, simhash, substring_dedup, token_output, toxicity
from .common import documents, scratch

#: The key of the pseudonyms in the query and the pipeline; a deployment passes its own.
DEMONSTRATION_KEY = b"lutrin demonstration key"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_output.write_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), path)
    return token_output.checksums(token_output.read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=rest != 1)
    return toxicity.score(docs, lexicon).select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind were replaced."""
    out = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), DEMONSTRATION_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), "pii_kinds")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir), keep_text=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/block/doc_id.txt, a block being a thousand ids. The table has no licence files, so a document whose last
    line is a notice of 15 words at most, as authors sign with, speaks for its block."""
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang", block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    last = F.substring_index("text", "\n", -1)
    return license_scan.scan(docs, licence_file=last.rlike(license_scan.SPEAKS) & (F.size(F.split(F.trim(last), "\\s+")) <= 15))


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, by the hash of its id, repeats what it has from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' runs, where one document in ten was made to repeat itself."""
    found = runs.collapse(documents(spark, sf_dir).select("doc_id", "text"), edit=repeated).drop("text")
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda y, x: F.when(more(x, y), x).otherwise(y))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), "runs", "collapsed")
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    said = F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    exponent = F.expr("1000 * b.length div b.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent, F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents; in the copy that is checked one row in three has its capitals A-Z lowered."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(tampered, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))
    return merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], copy={"text": text})


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_quality, op4_token_output, op5_decontamination, op6_toxicity, op7_pii, op8_lm_scoring, op9_substring_dedup, op10_license_scan, op11_periodic_runs, op12_merkle_manifest, op13_ngram_jaccard)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def merkle_sql(levels: int = 7, above: int = 3) -> str:
    """The manifest level by level: up to 8 to the power of ``levels`` rows a tree, of ``above`` trees."""
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i))"
    crc = "xor(4294967295, list_reduce(list_transform(range(len(doc_id::varchar)), lambda k: ascii((doc_id::varchar)[k + 1])::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"
    mark = lambda x: f"coalesce(concat(strlen({x}::varchar), ':', {x}::varchar), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(mark(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    low = f"case when doc_id is not null and {crc} % 3 = 0 then translate(text, '{CAPITALS}', '{CAPITALS.lower()}') else text end"
    parts = [f"crc as materialized (select {table} as t)", f"rows_ as (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as leaf, {leaf('copy')} as seen from (select *, {low} as copy from documents, crc))", "a0 as (select *, leaf as h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from rows_)"]

    def climb(name: str, steps: int) -> None:
        for k in range(steps):
            parts.append(f"{name}run{k} as (select g, pos // 8 as p, any_value(n) as n, list(h order by pos) as hs from {name}{k} where n > 1 group by all)")
            parts.append(f"{name}{k + 1} as (select g, p as pos, sha256(array_to_string(hs, '')) as h, (n + 7) // 8 as n from {name}run{k})")

    climb("a", levels)
    parts.append("subs as (" + " union all ".join(f"select g, h from a{k} where n = 1" for k in range(levels + 1)) + ")")
    parts.append("b0 as (select '' as g, g as tree, h, row_number() over (order by g) - 1 as pos, count(*) over () as n from subs)")
    climb("b", above)
    parts.append("top as (" + " union all ".join(f"select h from b{k} where n = 1" for k in range(above + 1)) + ")")
    parts.append("s0 as (select doc_id, leaf, g, pos, seen as h, '' as proof from a0)")

    def fold(name: str, out: str, runs: str, steps: int, key: str) -> str:
        for k in range(steps):
            before, after = f"coalesce(array_to_string(hs[:pos % 8], ''), '')", f"coalesce(array_to_string(hs[pos % 8 + 2:], ''), '')"  # noqa: F541
            parts.append(f"{out}{k + 1} as (select s.* exclude (pos, h, proof), case when hs is null then pos else pos // 8 end as pos, case when hs is null then h else sha256({before} || h || {after}) end as h, proof || {before} || {after} as proof from {name} s left join {runs}run{k} r on r.g = {key} and r.p = s.pos // 8)")
            name = f"{out}{k + 1}"
        return name

    last = fold("s0", "s", "a", levels, "s.g")
    parts.append(f"u0 as (select x.* exclude (pos), b0.pos as pos, b0.h as subroot from {last} x join b0 on b0.tree = x.g)")
    last = fold("u0", "u", "b", above, "''")
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, (select h from top) as root, sha256(proof) as proof_sha256, x.h as folded_root, x.h = (select h from top) as verified from {last} x"


#: DuckDB SQL of the queries that it can express: windows of words as strings, over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op13_ngram_jaccard": rf"""with recursive d as (select doc_id, row_number() over () as r, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct r, array_to_string(w[k:k + 2], ' ') as x from (select r, w, unnest(range(1, greatest(2, len(w) - 1))) as k from d where len(w) > 0)),
n as materialized (select r, count(*) as n from s group by r),
alike as materialized (select a.r as a, b.r as b from s a join s b using (x) join n na on na.r = a.r join n nb on nb.r = b.r where a.r <> b.r and 100 * na.n >= 90 * nb.n and 100 * nb.n >= 90 * na.n group by a.r, b.r, na.n, nb.n having 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reached as (select r, r as x from d union select reached.r, alike.b from reached join alike on alike.a = reached.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(o.doc_id) as component_id from d left join n using (r) join reached using (r) join d o on o.r = reached.x group by d.r, d.doc_id, n.n""",
    "op12_merkle_manifest": merkle_sql(),
    "op5_decontamination": f"""with d as (select doc_id, row_number() over () as r, {ITEM_WORDS} as w from documents), b as (select item_id::varchar as item, {ITEM_WORDS} as w from benchmark),
phrases as (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') as x from (select item, w, least(10, len(w)) as n, unnest(range(1, greatest(2, len(w) - 8))) as k from b where len(w) > 0)),
places as (select r, n, k, array_to_string(w[k:k + n - 1], ' ') as x from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from phrases) where len(w) >= n)),
hits as (select distinct r, n, k, item from places join phrases using (n, x)),
covered as (select r, count(*) as n_hit from (select distinct r, unnest(range(k, k + n)) as p from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (r) left join items using (r)""",
    "op9_substring_dedup": r"""with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select r, k, md5(array_to_string(w[k:k + 34], ' ')) as x from (select r, w, unnest(range(1, len(w) - 33)) as k from d where len(w) >= 35)),
gone as (select distinct r, unnest(range(k, k + 35)) as p from windows where x in (select x from windows group by x having count(*) > 1)),
words as (select r, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (select r, string_agg(x, ' ' order by p) as t from words anti join gone using (r, p) group by r),
removed as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r) left join removed using (r)""",
}
