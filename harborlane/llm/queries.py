"""The registered queries of this subpackage, and SQL for those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane import session
from harborlane.llm import (
    bpe, conversations, html_blocks, language, lexical, licenses, line_dedup, mixing, neighbours, simhash, topk,
    toxicity, warc,
)
from harborlane.llm.common import LOWER, UPPER, held_out, table
from harborlane.llm.conversation_sql import repair_sql
from harborlane.llm.vectors import divisible

VOCABULARY = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    taught = docs.where(~held_out(F.col("doc_id")))
    weights = toxicity.train(taught, table(spark, folder, "labels"))
    return toxicity.score(docs, weights).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select(
        "row.doc_id",
        F.col("lines").alias("n_lines"),
        F.col("dropped").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), divisible(100), top=10)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = session.fresh_dir(spark, "llm-warc")
    warc.write_archives(table(spark, folder, "pages"), archives)
    return (
        warc.read_archives(spark, archives, payload=False)
        .where(F.col("gap").isNull())
        .select(
            warc.page_of(F.col("record_id")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            warc.page_of(F.col("refers_to")).alias("refers_to"),
        )
    )


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(bpe.encode(docs, vocabulary, ["doc_id"], decoded=True), ["doc_id"])


def digests(decoded: DataFrame, keep: list[str]) -> DataFrame:
    return decoded.select(
        *keep,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    field = html_blocks.train(pages)
    return html_blocks.extract(pages, field).select(
        "row.page_id", "row.url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), divisible(20), top=20)


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    model = language.learn(docs.where(language.learnable(out, "text", "lang")))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.digests(turns, conversations.audits(turns))


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    base = F.filter("places", lambda place: place["phrase"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")
    return licenses.scan(docs, ["doc_id"]).withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        "score",
    )


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lexical.search(docs.select("doc_id", "text"), items, top=10).select(
        "item.item_id", "rank", "doc_id", "score"
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_toxicity, op2_line_dedup, op3_topk, op4_warc, op5_bpe, op6_simhash, op7_html,
        op8_mixing, op9_neighbours, op10_language, op11_repair,
        op12_licenses, op13_lexical,
    )
}


def licenses_sql() -> str:
    """Phrases by the positions of their words, templates as regular expressions."""
    starts, found, weights, labels = [], [], [], []
    for k, form in enumerate(licenses.forms()):
        if form.phrase:
            places = " and ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(form.parts))
            starts.append(f"list_filter(range(1, len(w) + 1), lambda i: {places}) as p{k}")
            here = f"len(p{k}) > 0"
        else:
            here = f"f{k}"
            found.append(f"regexp_matches(joined, '{licenses.pattern(form)}') as f{k}")
        weights.append(f"case when {here} then {form.mandatory} else 0 end")
        labels.append((form.phrase, f"case when {here} then ['{form.label}'] else [] end"))
    joined = lambda lists: (
        f"array_to_string(list_sort(list_distinct(flatten([{', '.join(lists)}]))), ',')"
    )
    every = f"flatten([{', '.join(s.split(' as ')[1] for s in starts)}])"
    return f"""
        with d as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{licenses.WORD}') as w
            from documents
        ), j as (
            select *, ' ' || array_to_string(w, ' ') || ' ' as joined from d
        ), p as (
            select doc_id, len(w) as n, {', '.join(starts + found)} from j
        )
        select doc_id, n::bigint as n_words, len({every})::bigint as n_base,
               (list_min({every}) - 1)::bigint as first_word,
               (list_max({every}) - 1)::bigint as last_word,
               {joined([x for phrase, x in labels if phrase])} as base_labels,
               {joined([x for _, x in labels])} as labels,
               case when n = 0 then 0.0
                    else least(1.0, ({' + '.join(weights)})::double / n) end::double as score
        from p
    """


ORACLES = {
    "op11_repair": repair_sql(),
    "op13_lexical": f"""
        with docs as (
            select row_number() over () as r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{lexical.TERM}') as terms
            from documents
        ), items as (
            select row_number() over () as number, item_id, unnest(list_distinct(regexp_extract_all(
                translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{lexical.TERM}'))) as term
            from benchmark
        ), totals as (
            select count(*) as n_docs, sum(len(terms))::bigint as n_terms
            from docs where len(terms) > 0
        ), held as (
            select r, doc_id, n, term, count(*) as tf
            from (select r, doc_id, len(terms) as n, unnest(terms) as term from docs)
            where term in (select term from items)
            group by all
        ), weights as (
            select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w
            from held, totals group by term, n_docs
        ), scored as (
            select number, item_id, r, doc_id, sum(
                w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))
            )::bigint as score
            from held join weights using (term) join items using (term), totals
            group by number, item_id, r, doc_id
        )
        select item_id, row_number() over (
                   partition by number order by score desc, doc_id nulls last)::int as rank,
               doc_id, score
        from scored where score > 0
        qualify rank <= 10
    """,
    "op12_licenses": licenses_sql(),
    "op2_line_dedup": f"""
        with docs as (
            select row_number() over () as r, doc_id,
                   string_split(coalesce(text, ''), chr(10)) as lines
            from documents
        ), lines as (
            select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from docs
        ), keyed as (
            select *, translate(
                trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                '{UPPER}', '{LOWER}') as key
            from lines
        ), frequent as (
            select key from (select distinct r, key from keyed where length(key) >= 1)
            group by key having count(*) >= 10
        )
        select any_value(doc_id) as doc_id, count(*) as n_lines, count(frequent.key) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i)
                               filter (where frequent.key is null), '')) as kept_sha256
        from keyed left join frequent on keyed.key = frequent.key
        group by r
    """,
    "op3_topk": """
        with v as (
            select vec_id,
                   [floor(1024 * x::double) for x in embedding] as q
            from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), scored as (
            select a.vec_id as query_id, b.vec_id,
                   list_inner_product(a.q, b.q)::bigint as score
            from v a join v b
              on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
        )
        select query_id,
               row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
               vec_id, score
        from scored
        qualify rank <= 10
    """,
    "op4_warc": """
        with p as (
            select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as size from pages
        ), shared as (
            select body, max(page_id) as holder from p where size >= 1000
            group by body having count(*) > 1
        )
        select page_id, size::bigint as payload_bytes, sha1(p.body) as payload_digest,
               case when holder is distinct from page_id and holder is not null
                    then 'revisit' else 'response' end as record_type,
               case when holder is distinct from page_id then holder end as refers_to
        from p left join shared on p.body = shared.body
    """,
    "op8_mixing": """
        with docs as (
            select doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
                   md5(concat_ws(':', '17', coalesce(doc_id::varchar, ''),
                                 md5(coalesce(text, '')))) as ord
            from documents
        ), sources as (
            select *, (place - 1) % 3 + 1 as weight, 3.0 * source_size as most,
                   sum(source_size) over () as total
            from (select source, sum(size)::bigint as source_size,
                         row_number() over (order by source is null, source) as place
                  from docs group by source)
        ), levels as (
            select *, (total - coalesce(sum(most) over before, 0))::double
                      / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
            from sources
            window before as (order by most / weight, place
                              rows between unbounded preceding and 1 preceding)
        ), shared as (
            select *, min_by(case when most > level * weight then level end,
                             case when most > level * weight then place * 0 + most / weight end)
                      over () as everyone
            from levels
        ), targets as (
            select *, case when most <= level * weight or everyone is null then most
                           else everyone * weight end::double as target
            from shared
        ), placed as (
            select d.doc_id, d.size, t.source_size, t.target,
                   floor(round(t.target, 6) + 0.5)::bigint as due,
                   sum(d.size) over (partition by d.source order by d.ord, d.size
                                     rows between unbounded preceding and current row)
                   - d.size as start
            from docs d join targets t on d.source is not distinct from t.source
        )
        select doc_id, size::bigint as size, source_size::bigint as source_size,
               round(target, 6) as target,
               (greatest(0, least(start + size, due) - start)
                + greatest(0, least(source_size + start + size, due) - (source_size + start))
                + greatest(0, least(2 * source_size + start + size, due)
                              - (2 * source_size + start)))::bigint as taken
        from placed
    """,
}
