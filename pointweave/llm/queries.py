"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import embeddings, fingerprints, html_wrapper, lexical, mixing, packing, phrases, privacy, quality, simhash, substring, url_trust, warc
from pointweave.sources.scratch import Scratch
from pointweave.sources.tables import read_table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_vectors(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken_words(mixing.mix(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    out = quality.scored(docs.withColumn("held_out", quality.is_held_out()), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "op4").path("warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), archives)
    return warc.read_archives(spark, archives)


def op5_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = privacy.all_spans(privacy.find(read_table(spark, sf_dir, "documents")))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(privacy.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(F.expr(privacy.listed("base")), 256).alias("base_sha256"), F.expr(privacy.listed("spans")).alias("spans"))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents"))
    near = [fingerprints.likeness("fp_text", "fp_edited").alias("near_edited"), fingerprints.likeness("fp_text", "fp_next").alias("near_next")]
    texts = [fingerprints.as_text("fp_text").alias("fingerprint"), fingerprints.as_text("fp_edited").alias("edited_fingerprint")]
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *texts, *near)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["to_word"] - r["from_word"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Fixed values of the query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op13_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_tier_packing": op5_tier_packing,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_disclosing_terms": op7_disclosing_terms,
    "op8_weighted_fingerprints": op8_weighted_fingerprints,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_url_trust": op12_url_trust,
    "op13_best_position_search": op13_best_position_search,
}

#: DuckDB SQL of the operators that SQL can express; the others are tested against plain Python in tests/llm.
ORACLE_SQL: dict[str, str] = {
    # One cell at the oracle's size, so that every pair is compared.
    "op1_embedding_near_dedup": """
with recursive v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
), u as (
    select vec_id, e, sqrt(list_dot_product(e, e)) as n from v
), l as (
    select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
    where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r(vec_id, low) as (
    select vec_id, vec_id from v union select l.b, r.low from r join l on r.vec_id = l.a
), d as (
    select a as vec_id, count(*) as n from l group by 1
), m as (
    select vec_id, min(low) as low from r group by 1
)
select m.vec_id, coalesce(d.n, 0) as n_links, m.low as component_id, m.vec_id = m.low as kept
from m left join d on m.vec_id = d.vec_id""",
    "op4_warc_round_trip": """
with p as (
    select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), k as (
    select html, max(page_id) as original from p where n >= 1000 group by 1 having count(*) > 1
)
select p.page_id, p.n as payload_bytes, sha1(p.html) as payload_digest,
    case when k.original is null or k.original = p.page_id then 'response' else 'revisit' end as record_type,
    case when k.original <> p.page_id then k.original end as refers_to
from p left join k on p.html = k.html and p.n >= 1000""",
    "op9_substring_dedup": r"""
with w as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), s as (
    select doc_id, words, unnest(range(greatest(len(words) - 19, 0))) as start from w
), g as (
    select doc_id, start, row_number() over (partition by list_slice(words, start + 1, start + 20) order by doc_id, start) as k from s
), c as (
    select distinct doc_id, start + unnest(range(20)) as pos from g where k > 1
), f as (
    select doc_id, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from w
), j as (
    select f.doc_id, f.n, f.word, f.pos, c.pos is not null as gone from f left join c on f.doc_id = c.doc_id and f.pos = c.pos
), o as (
    select doc_id, max(n) as n_words, sum(case when gone then 1 else 0 end) as n_removed, sha256(coalesce(string_agg(case when gone then null else word end, ' ' order by pos), '')) as kept_sha256
    from j group by 1
)
select w.doc_id, len(w.words) as n_words, cast(coalesce(o.n_removed, 0) as bigint) as n_removed, coalesce(o.kept_sha256, sha256('')) as kept_sha256
from w left join o on w.doc_id = o.doc_id""",
    "op11_phrase_collocations": r"""
with p as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
), g as (
    select lang, w, unnest(range(1, 6)) as k from w
), o as (
    select lang, k, unnest(list_transform(range(greatest(len(w) - k + 1, 0)), lambda i: list_slice(w, i + 1, i + k))) as ws from g
), f as (
    select lang, k, ws, array_to_string(ws, ' ') as phrase, count(*) as f from o group by 1, 2, 3
), n as (
    select lang, sum(f)::bigint as n from f where k = 1 group by 1
), c as (
    select lang, k, ws, phrase, f as a from f where k > 1 and f >= 100
), s as (
    select lang, a, k, ws, unnest(range(2, k)) as size from c
), t as (
    select lang, a, unnest(list_transform(range(k - size + 1), lambda i: list_slice(ws, i + 1, i + size))) as ws from s
), longer as (
    select lang, ws, max(a) as longer from t group by 1, 2
), free as (
    select c.* from c left join longer on c.lang = longer.lang and c.ws = longer.ws where longer.longer is null or 100 * longer.longer < 100 * c.a
), cut as (
    select lang, phrase, ws, a, unnest(range(1, k)) as cut from free
), scored as (
    select cut.lang, cut.phrase, cut.a, cut.cut, x.f as l, y.f as r, n.n, (1000::hugeint * cut.a * n.n) // (x.f::hugeint * y.f) as score
    from cut join f x on x.lang = cut.lang and x.ws = list_slice(cut.ws, 1, cut.cut) join f y on y.lang = cut.lang and y.ws = list_slice(cut.ws, cut.cut + 1, len(cut.ws)) join n on n.lang = cut.lang
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from best
qualify rank <= 2000""",
    "op12_url_trust": r"""
with recursive u as (
    select page_id, html, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), p as (
    select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), rules(verdict, rule, h, q) as (
    values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fit as (
    select page_id, verdict, rule from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
    qualify row_number() over (partition by page_id order by length(rule) desc, length(h) desc) = 1
), found as (
    select p.*, fit.rule, fit.verdict from p left join fit using (page_id)
), hosts as (
    select host, count(*) as n, count(*) filter (verdict = 'allow') as trust, count(*) filter (verdict = 'block') as distrust from found where host <> '' group by 1
), base as (
    select 'trust' as kind, host, (15 * (1000000000 * trust // n)) // 100 as mass from hosts where trust > 0
    union all select 'distrust', host, (15 * (1000000000 * distrust // n)) // 100 from hosts where distrust > 0
), links as (
    select distinct host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\s]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from found where host <> ''
), edges as (
    select *, count(*) over (partition by kind, src) as degree from (
        select 'trust' as kind, src, dst from links where src <> dst union all select 'distrust', dst, src from links where src <> dst)
), walk(round, kind, host, mass) as (
    select 1, kind, host, cast(mass as hugeint) from base
    union all
    select round, kind, host, cast(sum(mass) as hugeint) from (
        select w.round + 1 as round, e.kind, e.dst as host, (w.mass * 85) // (100 * e.degree) as mass from walk w join edges e on e.kind = w.kind and e.src = w.host where w.round < 50
        union all
        select distinct w.round + 1, b.kind, b.host, b.mass from base b, (select distinct round from walk where round < 50) w
    ) group by 1, 2, 3
), net as (
    select host, sum(case kind when 'distrust' then mass else -mass end) as net from walk where round = 50 group by 1
)
select page_id, host, path, rule, coalesce(verdict, case when net.net >= 75000000 then 'block' end, 'allow') as verdict from found left join net using (host)""",
    "op13_best_position_search": r"""
with d as (
    select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
), c as (
    select count(*) as docs, sum(len(terms))::bigint as words from d where len(terms) > 0
), m as (
    select k, doc_id, terms, 10 + (90 * len(terms) * docs) // words as m from d, c where len(terms) > 0
), q as (
    select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), o as (
    select k, doc_id, m, unnest(terms) as term from m
), t as (
    select k, doc_id, m, term, count(*) as tf from o where term in (select term from q) group by 1, 2, 3, 4
), w as (
    select term, cast(floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from t, c group by 1
), s as (
    select q.item_id, t.k, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * t.m)))::bigint as score from t join w using (term) join q using (term) group by 1, 2, 3
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0 qualify rank <= 10""",
}
