import math

import pytest
from docs import ODD, clashing, frame
from pyspark.sql import functions as F

from relaypack.llm import langid


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on few labelled rows; the others are held out."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    out = langid.documents(spark, docs, sample=150).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("lang is not null and n_chars >= 100").collect()
    assert sum(r.language == r.lang for r in out) / len(out) >= 0.95
    assert sum(r.accepted for r in out) / len(out) >= 0.98


def test_declared_language_suffix_and_host_decide_short_texts(spark):
    def text(lang, i):
        w = {"en": "the house and the river are near this little town", "fr": "la maison et le fleuve sont dans cette petite ville"}[lang].split()
        return " ".join(w[i % 4 :] + w[: i % 4])

    labelled = [(i, text("en" if i % 2 else "fr", i), "en" if i % 2 else "fr") for i in range(60)]
    languages, model = langid.fit(spark.createDataFrame(labelled, "doc_id bigint, text string, lang string"), key="doc_id", text="text", label="lang")
    assert languages == ["en", "fr", "und"]
    rows = [(i, text("fr", i), "www.a.fr", "fr", None) for i in range(40)] + [(100 + i, text("en", i), "www.b.com", "com", None) for i in range(40)]
    rows += [(200, "ok", "www.a.fr", "fr", None), (201, "ok", "www.b.com", "com", None), (202, "ok", "www.b.com", "com", "fr"), (203, "ok", None, None, "fr"), (204, "", "www.a.fr", "fr", "fr"), (205, None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string, host string, suffix string, declared string")
    got = {r.doc_id: r for r in langid.identify(spark, df, languages, model, key="doc_id").collect()}
    assert got[200].language == "fr" and got[201].language == "en" and got[203].language == "fr"
    assert got[202].probability < got[201].probability or got[202].language == "fr"
    assert all(got[i].language == "und" and not got[i].accepted and got[i].probability == 0 for i in (204, 205))
    assert all(got[i].language == "fr" and got[100 + i].language == "en" for i in range(40))


def test_odd_rows(spark):
    out = langid.documents(spark, frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert not any(r.accepted for i in (100, 101, 102) for r in by[i])
    assert len({tuple(r) for r in by[103]}) == 1
    assert len(langid.documents(spark, clashing(frame(spark, ODD))).collect()) == len(ODD)
    assert langid.documents(spark, frame(spark, [])).collect() == []
    unlabelled = [(i, "some words", None, None, None) for i in range(3)]
    assert all(r.language == "und" for r in langid.documents(spark, frame(spark, unlabelled)).collect())


def test_pages(spark, sf_dir):
    out = langid.pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(out) == 50 and sum(r.accepted for r in out) >= 45
    agree = [r.language == r.declared for r in out if r.declared and r.n_trigrams > 200]
    assert sum(agree) >= 0.9 * len(agree)


def fused(rows, languages, declared_in_x=True):
    """The fusion row by row: ``rows`` are likelihoods (id, host, suffix, declared, n, x, p)."""
    k = len(languages)
    base = [langid.UNKNOWN_PRIOR if x == "und" else (1 - langid.UNKNOWN_PRIOR) / max(1, k - 1) for x in languages]
    add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    every, hosts, suffixes = [0.0] * k, {}, {}
    for r in rows:
        every = add(every, r.p)
        if r.host is not None:
            hosts[r.host] = add(hosts.get(r.host, [0.0] * k), r.p)
        if r.suffix is not None:
            suffixes[r.suffix] = add(suffixes.get(r.suffix, [0.0] * k), r.p)
    out = {}
    for r in rows:
        less = lambda total: [max(a - b, 0.0) for a, b in zip(total, r.p, strict=True)]  # noqa: B023, E731
        above = [x + 1 for x in less(every)]
        above = [x / sum(above) for x in above]
        suffix = less(suffixes[r.suffix]) if r.suffix is not None else [0.0] * k
        lang = langid.COUNTRY.get((r.suffix or "").lower())
        if lang in languages:
            suffix[languages.index(lang)] += langid.COUNTRY_WEIGHT
        level = [(s + langid.SUFFIX_WEIGHT * a) / (sum(suffix) + langid.SUFFIX_WEIGHT) for s, a in zip(suffix, above, strict=True)]
        host = less(hosts[r.host]) if r.host is not None else [0.0] * k
        prior = [(h + langid.HOST_WEIGHT * x) / (sum(host) + langid.HOST_WEIGHT) for h, x in zip(host, level, strict=True)]
        score = [x + math.log(p) for x, p in zip(r.x, prior, strict=True)]
        odds = [math.exp(x - max(score)) for x in score]
        best = score.index(max(score))
        text = [x + math.log(b) for x, b in zip(r.x, base, strict=True)]
        out[r.id] = ("und", 0.0, "und", False) if not r.n else (languages[best], odds[best] / sum(odds), languages[text.index(max(text))], languages[best] != "und")
    return out


def _equal(got, want):
    assert len(got) == len(want)
    for r in got:
        language, chance, text, accepted = want[r[0]]
        assert (r.language, r.text_language, r.accepted) == (language, text, accepted) and r.probability == pytest.approx(chance, abs=1e-9)


def test_fusion_equals_plain_python_over_whole_tables(spark, sf_dir):
    docs, web = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    languages, model = langid.fit(docs, key="doc_id", text="text", label="lang")
    # hosts with suffixes, declarations and texts of a few words: all four pieces of evidence at work
    some = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.substring_index("text", " ", 2)).otherwise(F.col("text")).alias("text"), F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".example.fr").otherwise(".example.com")).alias("host"))
    some = some.withColumns({"suffix": F.regexp_extract("host", "[a-z]+$", 0), "declared": F.when(F.col("id") % 5 == 0, "de").when(F.col("id") % 5 == 1, "xx")})
    told = langid.likelihoods(some, languages, model).collect()
    assert {r.suffix for r in told} == {"fr", "com"} and any(r.declared == "de" for r in told)
    _equal(langid.identify(spark, some, languages, model, key="id").collect(), fused(told, languages))
    out = langid.pages(spark, web, docs).collect()
    assert all(r.host and r.suffix for r in out) and any(r.declared for r in out)


def test_many_labels_and_far_declarations(spark):
    letters = "bcdfghjklmnpqrstvwxyz"
    name = lambda i: f"l{i:02d}"
    text = lambda i: " ".join(f"{letters[i % 21]}{v}{letters[(i * 5 + 3) % 21]}{letters[i // 21]}" for v in "aeiouaeiou")
    rows = [(61 * j + i, text(i), name(i), "s", 1) for i in range(61) for j in range(2)]
    out = langid.documents(spark, frame(spark, rows)).collect()
    assert sum(r.language == name(r.doc_id % 61) for r in out) >= 118
    page = f'<html {"data-x=y " * 60} class="a" lang="fr-CA"><body>ok</body></html>'
    assert len(page) > 500
    got = spark.createDataFrame([(page,), ('<html xml:lang="de">',), ("<html><p lang=en>",), ('<HTML LANG=es>',)], "t string").select(langid._declared("t").alias("d")).collect()
    assert [r.d for r in got] == ["fr", None, None, "es"]


def test_pages_decode_references(spark):
    web = spark.createDataFrame([(1, "http://x.example.com/", "<p>caf&eacute; &#233;t&#xe9;</p><script>no()</script>")], "page_id bigint, url string, html string")
    from relaypack.llm.html_density import visible_text

    assert visible_text(web.first().html) == "café été"


def test_pages_are_read_in_the_worker_that_judges_them(spark, sf_dir, monkeypatch):
    """A function of its own for the visible text was a second Python worker beside each task's first."""
    plans = {}

    def seen(spark, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(spark, df, name)

    materialize = langid.materialize
    monkeypatch.setattr(langid, "materialize", seen)
    langid.pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").limit(5), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert plans["likelihoods"].count("MapInArrow") == 1
