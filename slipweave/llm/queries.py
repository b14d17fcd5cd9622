"""Driver queries of the text operators, with DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import table
from . import decontaminate, embeddings, html, pieces, quality, simhash, suffix, tokenstore, urlfilter, warc

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_warc_revisits(spark: SparkSession, d: str) -> DataFrame:
    found = warc.deduplicate(spark, table(spark, d, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html.main_text(table(spark, d, "pages"))


def op4_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, d, "labels")))


def op5_url_filters(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(repr, RULES)) + " as t(host, path, action)")
    return urlfilter.judge(spark, table(spark, d, "pages"), rules)


def op6_token_store(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return tokenstore.store_and_read(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix.deduplicate(table(spark, d, "documents")).drop("spans")


def op9_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_embedding_caps(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_url_filters": op5_url_filters,
    "op6_token_store": op6_token_store,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_embedding_caps": op10_embedding_caps,
    "pipeline": pipeline,
}

_RULES = "(values " + ", ".join(map(repr, RULES)) + ") r(h, p, action)"

ORACLE: dict[str, str] = {
    "op2_warc_revisits": """
with b as (select page_id, encode(coalesce(html, '')) body from pages),
s as (select page_id, octet_length(body) payload_bytes, sha1(body) || '0' x from b),
t as (select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(x, (5 * i) // 4 + 1, 2))::int >> (3 - (5 * i) % 4)::int) & 31), 1)), 'string_agg', '') payload_digest from s),
m as (select *, min(page_id) over (partition by payload_digest) f from t)
select page_id, payload_bytes, payload_digest, case when page_id = f then 'response' else 'revisit' end record_type,
       case when page_id <> f then f end refers_to from m""",
    "op5_url_filters": f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
u as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from a),
f as (select page_id, first(h || p order by length(h || p) desc) "rule", first(action order by length(h || p) desc) action
      from u join {_RULES} on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select u.page_id, host, path, f."rule", coalesce(action, 'allow') verdict from u left join f using (page_id)""",
    "op8_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
w as (select doc_id, i, substr(x, 2 * i + 1, 200) s from (select doc_id, x, unnest(range(length(x) // 2 - 99)) i from d where length(x) >= 200)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from w) where k > 1),
g as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 100, -1) opens from r),
n as (select doc_id, i, sum(opens::int) over (partition by doc_id order by i) span from g),
p as (select doc_id, min(i) a, max(i) + 100 e from n group by doc_id, span),
q as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) upto from p),
t as (select doc_id, count(*) n_spans, sum(e - a) n_removed, max(e) last,
             string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' order by a) kept
      from q join d using (doc_id) group by doc_id)
select doc_id, length(x) // 2 n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) kept_sha256 from d left join t using (doc_id)""",
    "op10_embedding_caps": """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id
      where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
r as (select vec_id a, vec_id b from v union select r.a, l.b from r join l on l.a = r.b),
c as (select a vec_id, min(b) component_id from r group by a),
n as (select a vec_id, count(*) n_links from l group by a)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept from c left join n using (vec_id)""",
}
