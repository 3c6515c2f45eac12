import hashlib
import re

import numpy as np
from docs import ODD, clashing, corpus, frame, words

from relaypack.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    least, split = {}, [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    big = lambda d: 2**63 - 1 if d is None else d
    for d, w in split:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            least[g] = min(least.get(g, 2**63), big(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < big(d):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_equals_brute_force(spark):
    rows = corpus() + ODD
    want = sorted((x[:4] for x in brute(rows)), key=key)
    assert result(substring.dedup(spark, frame(spark, rows))) == want
    assert any(x[2] > 0 for x in want)
    # many small blocks give the same
    assert result(substring.dedup(spark, frame(spark, rows), block_bytes=2000)) == want


def test_planted_passage_goes_from_all_but_the_first(spark):
    passage = words(80, 1)
    rows = [(i, f"{words(30, 10 + i)} {passage} {words(30, 90 + i)}", "en", "s", 1) for i in range(6)]
    got = {r.doc_id: r.n_removed for r in substring.dedup(spark, frame(spark, rows)).collect()}
    assert got[0] == 0 and all(got[i] == 80 for i in range(1, 6))


def test_text_form_keeps_columns_and_untouched_texts(spark):
    rows = corpus() + ODD
    df = frame(spark, rows)
    out = substring.dedup(spark, df, text_out=True)
    assert out.columns == [*df.columns, "n_removed"]
    want = sorted(((d, old[1] if not gone else kept) for (d, _, gone, _, kept), old in zip(brute(rows), rows, strict=True)), key=key)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == want


def test_clashing_columns_and_empty_table(spark):
    df = clashing(frame(spark, corpus()))
    assert result(substring.dedup(spark, df)) == result(substring.dedup(spark, frame(spark, corpus())))
    out = substring.dedup(spark, df, text_out=True)
    assert set(df.columns) <= set(out.columns)
    assert out.where("block = 'clash' and n = 'clash'").count() == df.count()
    assert substring.dedup(spark, frame(spark, [])).collect() == []
    assert substring.dedup(spark, frame(spark, []), text_out=True).collect() == []


def test_hash_of_pieces_does_not_depend_on_cuts():
    import pyarrow as pa

    text = (words(5000, 4) + " ").encode() * 3
    table = pa.table({"doc_id": pa.array([1]), "text": pa.array([text.decode()])})
    whole = substring.Block(table, 2)
    old, substring.PIECE = substring.PIECE, 997
    try:
        cut = substring.Block(table, 2)
    finally:
        substring.PIECE = old
    assert all(np.array_equal(a, b) for a, b in zip(whole.words, cut.words, strict=True)) and np.array_equal(whole.starts, cut.starts)


def test_many_rows_of_one_id_are_spread(spark):
    passage = words(40, 7)
    rows = [(None, f"{words(20, i)} {passage}", "en", "s", 1) for i in range(60)] + [(5, passage, "en", "s", 1)] * 60 + [(6, f"{passage} end", "en", "s", 1)]
    df = frame(spark, rows).repartition(5)
    for block_bytes in (None, 3000):
        assert result(substring.dedup(spark, df, block_bytes=block_bytes)) == sorted((x[:4] for x in brute(rows)), key=key)
    got = substring.dedup(spark, df, block_bytes=3000, text_out=True).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((d, t if not gone else kept) for (d, _, gone, _, kept), (_, t, *_) in zip(brute(rows), rows, strict=True)), key=key)
