"""The thin queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relaypack.llm import bpe, html_density, langid, licenses, licenses_sql, matroska, mixing, neardup, substring, token_store, topk
from relaypack.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op5_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_back(spark, token_store.write(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark, table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the mix: sizes and targets of all documents."""
    return op2_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.documents(spark, table(spark, sf_dir, "documents"))


def llm_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.pages(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def llm_media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the media column: the payloads read back from all files."""
    return op4_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=2)


QUERIES: dict[str, Query] = {
    "op3_language_id": op3_language_id,
    "op9_license_scan": op9_license_scan,
    "llm_page_languages": llm_page_languages,
    "op10_near_duplicates": op10_near_duplicates,
    "op1_substring_dedup": op1_substring_dedup,
    "op5_html_density": op5_html_density,
    "op8_token_store": op8_token_store,
    "op2_source_mix": op2_source_mix,
    "op4_matroska": op4_matroska,
    "op7_exact_top_k": op7_exact_top_k,
    "op6_byte_bpe": op6_byte_bpe,
    "llm_mix_targets": llm_mix_targets,
    "llm_media_payloads": llm_media_payloads,
}

SQL: dict[str, str] = {
    # the page's own article element, its blocks parted by white space: what density is to find, told another way
    "op5_html_density": r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) as a from pages),
b as (select page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br|div|ul|li)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') as b from a),
t as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as text from b)
select page_id, url, text, length(text)::bigint as n_chars from t""",
    "llm_mix_targets": r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as n, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::double as w from d group by source),
r as (select *, 2 * n::double / w as full_at from s),
e as (select full_at, ((select 1.5::double * sum(n)::double from s) - 2 * coalesce((select sum(n)::double from r x where x.full_at < r.full_at), 0)) / (select sum(w) from r x where x.full_at >= r.full_at) as level from r),
l as (select arg_min(level, full_at) as level from e where level <= full_at)
select doc_id, size, n as source_size, case when level is null or level * w > 2 * n::double then 2 * n::double else level * w end as target
from d join r on d.source is not distinct from r.source cross join l""",
    "llm_media_payloads": """with b as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, octet_length(b)::bigint as n_bytes, greatest(1, (octet_length(b) + 575) // 576)::bigint * 576 as payload_bytes, b from b)
select doc_id, n_bytes, payload_bytes, sha256(b || unhex(repeat('FF', (payload_bytes - n_bytes)::int))) as payload_sha256 from p""",
    "op1_substring_dedup": r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
m as (select g, min(doc_id) as least from g group by g),
gone as (select distinct doc_id, i + k as p from g join m using (g), range(13) r(k) where least < doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op7_exact_top_k": """with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as w from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op10_near_duplicates": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select distinct on (t) doc_id, t from (select doc_id, list(g order by g)::varchar as t from s group by doc_id) order by t, doc_id),
named as (select d.doc_id, c.doc_id as cls from (select doc_id, list(g order by g)::varchar as t from s group by doc_id) d join c using (t)),
r as (select s.doc_id, s.g, n.n from s join n using (doc_id) where doc_id in (select doc_id from c)),
l as (select a.doc_id as a, b.doc_id as b from r a join r b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from l union all select b, a from l),
reach(x, y) as (select doc_id, doc_id from c union select reach.x, e.b from reach join e on e.a = reach.y),
comp as (select x as cls, min(y) as y from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(comp.y, d.doc_id), d.doc_id) as component_id, coalesce(comp.y, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join named using (doc_id) left join comp using (cls)""",
}


def sql() -> dict[str, str]:
    """All SQL; the licence scan's holds its fitted model."""
    return SQL | {"op9_license_scan": licenses_sql.sql()}
