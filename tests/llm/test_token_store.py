import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from docs import ODD, clashing, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from relaypack.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: tuple(map(str, r)))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def test_equals_library(spark, sf_dir):
    rows = corpus() + ODD
    for df, how in ((frame(spark, rows), {}), (frame(spark, rows), {"file_bytes": 4000}), (clashing(frame(spark, rows)), {"mode": ts.BITS})):
        assert result(ts.read_back(spark, ts.write(spark, df, PATH, **how))) == want(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(ts.read_back(spark, ts.write(spark, docs, PATH))) == want([tuple(r) for r in docs.collect()])
    assert ts.read_back(spark, ts.write(spark, frame(spark, []), PATH)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("aB, .\n'é<|endoftx>1", max_size=120))
def test_pieces_equal_whole_texts(text):
    ids = _lib().encode(text, add_special_tokens=False).ids
    assert ts.tokenizer(PATH).encode([text.encode()])[0] == np.array(ids, "<u4").tobytes()


_cache = []


def _lib():
    if not _cache:
        _cache.append(Tokenizer.from_file(PATH))
    return _cache[0]


@pytest.mark.parametrize("mode", [ts.BYTES, ts.BITS])
@pytest.mark.parametrize("top", [0, 1, 255, 256, 49407, 2**32 - 1])
def test_planes_round_trip(mode, top):
    ids = np.random.default_rng(top).integers(0, top + 1, 5000).astype("<u4")
    f = io.BytesIO()
    w = ts.Writer(f, mode=mode, block=512)
    parts = np.array_split(ids, 7)
    for i, part in enumerate(parts):
        w.append(None if i == 2 else 1 - i, part)
    w.close()
    r = ts.Reader(f)
    (ids_of, null, counts), = r.documents()
    assert ids_of.tolist() == [1, 0, 0, -2, -3, -4, -5] and null.tolist() == [i == 2 for i in range(7)] and counts.tolist() == [len(x) for x in parts]
    assert np.array_equal(np.concatenate(list(r)), ids) and np.array_equal(r.block(3), ids[1536:2048])


def test_damage_is_found():
    f = io.BytesIO()
    w = ts.Writer(f)
    w.append(1, np.arange(10, dtype="<u4"))
    w.close()
    raw = bytearray(f.getvalue())
    raw[-ts.TAIL.size - len(ts.END) - 1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ts.Reader(io.BytesIO(bytes(raw)))
    with pytest.raises(ValueError, match="end"):
        ts.Reader(io.BytesIO(bytes(raw[:-1])))


def test_one_file_a_range_and_no_leftovers(spark):
    manifest = ts.write(spark, frame(spark, corpus()), PATH, file_bytes=4000).collect()
    folder = os.path.dirname(manifest[0].file.removeprefix("file://"))
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(m.file) for m in manifest)


def test_values_come_from_the_files_and_one_id_has_many_files(spark, monkeypatch):
    rows = [(None, f"text {i % 40} of a null id", "en", "s", 1) for i in range(400)] + corpus()
    manifest = ts.write(spark, frame(spark, rows), PATH, file_bytes=1500)
    assert "doc_ids" not in manifest.columns and manifest.count() > 5
    assert result(ts.read_back(spark, manifest)) == want_by_tie(spark, rows)
    monkeypatch.setattr(ts, "GROUP", 3)
    assert result(ts.read_back(spark, manifest)) == want_by_tie(spark, rows)


def want_by_tie(spark, rows):
    """As ``want``, with rows of equal id in the order of the text's hash."""
    tie = {(r[0], r[1]): r[2] for r in frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[0], r[1]])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: tuple(map(str, r)))
