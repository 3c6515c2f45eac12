import hashlib
import struct
import zlib

import numpy as np
import pytest
from docs import ODD, clashing, corpus, frame

from relaypack.llm import matroska as mk


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("size", [576, 577, 5000, 576 * 200, 576 * 1100])
def test_round_trip(lacing, size):
    raw = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    if lacing == "fixed":
        raw = mk.pad(raw)
    b = mk.mux(raw, lacing=lacing)
    m = mk.parse(b)
    assert mk.payload_of(b, m, 1) == raw
    assert [p[1] for p in m.packets] == [i * 12_000_000 for i in range(-(-len(raw) // 576))]
    assert all(0 < p[3] < len(b) and p[2] for p in m.packets)
    assert [t for t, _, _ in m.cues] == [i * 12_000_000 for i in range(0, len(m.packets), (1 if lacing == "none" else mk.LACED) * mk.BLOCKS)]
    assert all(b[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in m.cues)


def test_block_groups_unknown_sizes_and_foreign_elements():
    """A file made by hand: unknown segment and cluster sizes, void elements, a block group with and without reference."""
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK, mk.uint(mk.NUMBER, 3) + mk.uint(mk.KIND, 1) + mk.element(mk.CODEC, b"V_X")))
    block = lambda t, data: mk.element(mk.BLOCK, b"\x83" + struct.pack(">hB", t, 0) + data)
    void = mk.element(0xEC, b"\0" * 5)
    group1 = mk.element(mk.BLOCK_GROUP, block(5, b"key") + mk.uint(0x9B, 40))
    group2 = mk.element(mk.BLOCK_GROUP, block(45, b"delta") + mk.element(0xFB, b"\xff"))
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = lambda t, body: mk.CLUSTER.to_bytes(4, "big") + unknown + mk.uint(mk.TIMESTAMP, t) + body
    b = mk._HEADER + mk.SEGMENT.to_bytes(4, "big") + unknown + void + tracks + cluster(0, group1 + void + group2) + cluster(100, group1)
    m = mk.parse(b)
    assert [(p[0], p[1], p[2], b[p[3] : p[3] + p[4]]) for p in m.packets] == [(3, 5_000_000, True, b"key"), (3, 45_000_000, False, b"delta"), (3, 105_000_000, True, b"key")]
    assert m.tracks[3].codec == "V_X" and len(m.clusters) == 2


@pytest.mark.parametrize("bad", [b"", b"RIFFxxxx", mk.mux(mk.pad(b"a" * 600))[:200], mk.mux(b"a" * 576)[40:]])
def test_damaged(bad):
    with pytest.raises(mk.MatroskaError):
        mk.parse(bad)


def test_query(spark):
    rows = corpus() + ODD
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    key = lambda r: tuple(map(str, r))
    for df in (frame(spark, rows), clashing(frame(spark, rows))):
        got = mk.digests(df).collect()
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        assert len({(r.media_sha256, r.feature) for r in got}) == len({t or "" for _, t, *_ in rows})
    assert mk.digests(frame(spark, [])).collect() == []


def test_packet_table(spark):
    rows = corpus()[:6] + ODD
    media = mk.media_column(frame(spark, rows)).cache()
    packets = mk.packet_table(media)
    held = {r.doc_id: bytes(r.media) for r in media.where("doc_id is not null").collect()}
    text = {d: (t or "").encode() for d, t, *_ in rows}
    got = {}
    for r in packets.where("doc_id is not null and doc_id <> 103").orderBy("doc_id", "packet").collect():
        got[r.doc_id] = got.get(r.doc_id, b"") + held[r.doc_id][r.byte_offset : r.byte_offset + r.byte_length]
    assert all(v == mk.pad(text[k]) for k, v in got.items()) and len(got) >= 10
    foreign = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id bigint, media binary")
    assert mk.packet_table(foreign).collect() == []
