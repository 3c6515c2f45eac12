"""Excerpts and probes by brute force, over whole tables."""

import re

import duckdb

from relaypack.plans import selection_queries as sq

ENDS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def brute(doc_id, text):
    ls = re.split(ENDS, text)
    ls = ls[:-1] if ls[-1] == "" else ls
    n = len(ls)
    k = 1 + doc_id % n
    ranges = sorted((f or 1, n if t is None else t, (f is None) != (t is None)) for f, t in ((None, None), (1, k), (k, k), (k, n), (n + 1, n + 1), (n + 2, None)))
    out, reach = [], 0
    for a, b, one in ranges:
        code = "one_bound" if one else "out_of_range" if not 1 <= a <= b <= n else "blank" if not "".join(ls[a - 1 : b]).strip() else "overlap" if reach >= a else None
        out.append((doc_id, a, b, code))
        reach = max(reach, b)
    return out


def key(r):
    return tuple(map(str, r))


def test_excerpts_cover_every_document(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    want = [r for d, t in rows if t and t.strip() for r in brute(d, t)]
    got = [tuple(r) for r in sq.QUERIES["excerpt_bounds_documents"](spark, sf_dir).collect()]
    assert len({r[0] for r in got}) == len(rows) > 6
    assert sorted(got, key=key) == sorted(want, key=key)


def test_excerpts_of_odd_texts(spark):
    rows = [(7, "a\r\n\r\nb\u2028c\n"), (8, "\n\n \nx"), (9, "one"), (-4, "a\nb\nc"), (10, " \n"), (11, None), (12, "l\n" * 3000)]
    got = [tuple(r) for r in sq.document_excerpts(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    want = [r for d, t in rows if t and t.strip() for r in brute(d, t)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_probes_are_whole_passages(spark, tmp_path):
    """A document with the opening alone, or with all but it, holds no passage."""
    passage = "".join(f"word{i} " for i in range(40)).strip()
    docs = [(0, "before " + passage + " after"), (1, passage[:100]), (2, passage[60:]), (3, passage), (4, None), (5, "")]
    items = [(0, passage), (1, "short"), (2, passage)]
    for name, rows, shape in (("documents", docs, "doc_id bigint, text string"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.item_id: r.n_texts for r in sq.probe_retention(spark, str(tmp_path)).collect()}
    assert got == {i: sum(t in (d or "") for _, d in docs) for i, t in items} == {0: 2, 1: 0, 2: 2}
