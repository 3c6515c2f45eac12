"""The licence scan as SQL for DuckDB, with the fitted model and the templates' n-grams as values."""

from __future__ import annotations

from relaypack.llm.license_texts import TEMPLATES
from relaypack.llm.licenses import COVER, LEAST, TOKEN, UNKNOWN, fit, grams


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql() -> str:
    m = fit()
    weights = ", ".join(f"({_text(g)}, {list(w)})" for g, w in sorted(m.weights.items()))
    bias = ", ".join(f"({i}, {_text(f)}, {b}::double)" for i, (f, b) in enumerate(zip(m.families, m.bias, strict=True)))
    marks = ", ".join(f"({_text(f)}, {i}, {len(grams(t))}, {_text(g)})" for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in sorted(grams(t)))
    return rf"""with weights(gram, w) as (values {weights}), bias(i, family, b) as (values {bias}), marks(family, template, size, gram) as (values {marks}),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as place from (select doc_id, regexp_split_to_array(lower(text), '\r?\n') as ls from documents where doc_id is not null and text is not null)),
words as (select doc_id, place, regexp_extract_all(line, '{TOKEN}') as t from lines),
grams as (select distinct doc_id, place, gram from (select doc_id, place, unnest(flatten([list_transform(range(1, len(t) + 2 - n), lambda i: array_to_string(t[i:i + n - 1], ' ')) for n in [1, 2, 3]])) as gram from words)),
parts as (select doc_id, place, unnest(w)::double as w, generate_subscripts(w, 1) - 1 as i from grams join weights using (gram)),
sums as (select doc_id, place, i, sum(w) as s from parts group by all),
logits as (select doc_id, place, i, family, (s + b) / {m.temperature}::double as z from sums join bias using (i)),
best as (select doc_id, place, arg_max(family, (z, -i)) as family, 1 / sum(exp(z - top)) as probability from (select *, max(z) over (partition by doc_id, place) as top from logits) group by doc_id, place),
sure as (select * from best where family <> '{UNKNOWN}' and probability >= {LEAST}),
covers as (select doc_id, place, max(c) as cover from (select s.doc_id, s.place, template, count(distinct g.gram) / any_value(size) as c from sure s join grams g using (doc_id, place) join marks k on k.family = s.family and k.gram = g.gram group by all) group by all),
told as (select s.*, coalesce(cover, 0) >= {COVER} as ok from sure s left join covers using (doc_id, place)),
by_doc as (select doc_id, string_agg(distinct family, ',' order by family) filter (ok) as families, arg_max(family, (probability, family)) filter (ok) as license, max(probability) filter (ok) as probability, count(*) filter (not ok) as n from told group by doc_id)
select d.doc_id, case when length(d.text) > 0 then len(list_filter(regexp_split_to_array(d.text, '\r?\n'), lambda x: length(trim(x)) > 0)) else 0 end::int as n_paragraphs, families, coalesce(license, '{UNKNOWN}') as license,
 round(probability, 6) as probability, coalesce(n, 0)::bigint as n_unconfirmed from documents d left join by_doc b on b.doc_id = d.doc_id"""
