import base64
import hashlib

import public_tokenizers
import tiktoken
from docs import ODD, clashing, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from relaypack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.encoder(PATH, public_tokenizers.PATTERN)


def want(text):
    ids = ORACLE.encode_ordinary(text or "")
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab \n\t.,'s1", max_size=200), max_size=5))
def test_equals_tiktoken(texts):
    for t, ids in zip(texts, ENCODER.encode(texts), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in ORACLE.encode_ordinary(t))
        assert ENCODER.decode(ids) == t.encode()


def test_long_words():
    for t in ("a" * 3000, "ab" * 999, "é" * 500, "x" * 24, "y" * 25, "<|endoftext|> z", " " * 300 + "q"):
        assert next(ENCODER.encode([t])) == b"".join(i.to_bytes(4, "little") for i in ORACLE.encode_ordinary(t))


def test_query(spark, sf_dir):
    rows = corpus() + ODD
    key = lambda r: tuple(map(str, r))
    expected = sorted(((d, *want(t)) for d, t, *_ in rows), key=key)
    for df in (frame(spark, rows), clashing(frame(spark, rows))):
        assert sorted((tuple(r) for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()), key=key) == expected
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.collect()}
    assert bpe.digests(frame(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def test_round_trip_column(spark):
    rows = corpus()[:5] + ODD
    out = bpe.encode_column(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t, *_ in rows)
