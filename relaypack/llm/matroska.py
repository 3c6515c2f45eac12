"""Media columns in Matroska: write byte payloads as 8-bit PCM audio, parse the stored bytes into packet tables.

The parser reads EBML elements (variable-length ids and sizes, unknown sizes of segments and clusters), tracks, clusters, simple
blocks and block groups with Xiph, fixed-size and EBML lacing, and cues. A packet has its track, time stamp in
nanoseconds, key flag, byte range in the file and its place in the lace.

A null payload counts as empty; an empty one is stored as one frame of bytes 255. Payloads are stored whole. Damaged
or foreign bytes raise ``MatroskaError`` in ``parse``; ``packet_table`` gives such media no packets and null media none.
Extra columns don't matter, repeated rows are stored alike.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 48_000  # so that a frame takes 12 ms
LACED = 64  # frames in a block
BLOCKS = 16  # blocks in a cluster

EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NUMBER, KIND, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH, DEFAULT_DURATION, SCALE, DURATION = 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x2AD7B1, 0x4489
UNKNOWN = -1
_TOP = {SEGMENT, CLUSTER, CUES, INFO, TRACKS, EBML, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


class MatroskaError(ValueError):
    """The bytes are no Matroska file that can be read."""


# ---- writing


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones mean unknown, so such a size takes a byte more."""
    w = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and body of a block with these frames."""
    if kind == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames[:-1]]
    if kind == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes) + b"".join(frames)
    if kind == "fixed":
        if len({len(f) for f in frames}) > 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, head + b"".join(frames)
    steps = size_bytes(sizes[0])
    for a, b in zip(sizes, sizes[1:], strict=False):
        d = b - a
        w = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
        steps += size_bytes(d + (1 << 7 * w - 1) - 1, w)
    return 0x06, head + steps + b"".join(frames)


_HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))


def mux(payload: bytes, *, frame: int = FRAME, rate: int = RATE, lacing: str = "fixed", laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """One track of 8-bit PCM, ``frame`` samples a packet (the last may be shorter unless lacing is fixed)."""
    tick = frame * 1_000_000_000 // rate
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * tick / 1e6)) + element(0x4D80, b"relaypack") + element(0x5741, b"relaypack"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(0x73C5, 1) + uint(KIND, 2) + uint(0x9C, 1) + uint(DEFAULT_DURATION, tick) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    each = 1 if lacing == "none" else laced
    for c in range(0, len(frames), each * blocks):
        start = c * tick // 1_000_000
        parts = [uint(TIMESTAMP, start)]
        for b in range(c, min(c + each * blocks, len(frames)), each):
            flags, data = lace(frames[b : b + each], lacing)
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * tick // 1_000_000 - start, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(body))


# ---- reading


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    depth: int = 0
    default_ns: int = 0


@dataclass
class Media:
    tracks: dict[int, Track] = field(default_factory=dict)
    scale: int = 1_000_000
    duration_ns: float = 0.0
    #: (track, time stamp in ns, key, offset, size, place in the lace)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    #: (time in ns, track, absolute offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _ident(b: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not b[at]:
        raise MatroskaError(f"no element id at {at}")
    w = 9 - b[at].bit_length()
    if w > 4 or at + w > end:
        raise MatroskaError(f"no element id at {at}")
    return int.from_bytes(b[at : at + w], "big"), at + w


def _size(b: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not b[at]:
        raise MatroskaError(f"no size at {at}")
    w = 9 - b[at].bit_length()
    if at + w > end:
        raise MatroskaError(f"a size is cut off at {at}")
    n = int.from_bytes(b[at : at + w], "big") & (1 << 7 * w) - 1
    return (UNKNOWN if n == (1 << 7 * w) - 1 else n), at + w


def elements(b: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of each child. An element of unknown size ends before one of its own level."""
    while at < end:
        ident, k = _ident(b, at, end)
        n, body = _size(b, k, end)
        if n == UNKNOWN:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"element {ident:X} has no size")
            stop = end
            if ident == CLUSTER:
                stop = body
                while stop < end:
                    child, k = _ident(b, stop, end)
                    if child in _TOP:
                        break
                    m, k = _size(b, k, end)
                    stop = k + m
            n = stop - body
        if body + n > end:
            raise MatroskaError(f"element {ident:X} at {at} reaches beyond its parent")
        yield ident, body, body + n
        at = body + n


def _uint(b: bytes, s: int, e: int) -> int:
    return int.from_bytes(b[s:e], "big")


def _float(b: bytes, s: int, e: int) -> float:
    return struct.unpack(">f" if e - s == 4 else ">d", b[s:e])[0] if e > s else 0.0


def _block(b: bytes, s: int, e: int, start: int, m: Media, key: bool | None) -> None:
    track, at = _size(b, s, e)
    if at + 3 > e:
        raise MatroskaError(f"block at {s} is cut off")
    relative, flags = struct.unpack_from(">hB", b, at)
    at += 3
    kind, count = flags & 6, 1
    if kind:
        count = b[at] + 1
        at += 1
    if kind == 2:
        sizes = []
        for _ in range(count - 1):
            n = 0
            while b[at] == 255:
                n += 255
                at += 1
            sizes.append(n + b[at])
            at += 1
        sizes.append(e - at - sum(sizes))
    elif kind == 6:
        sizes, n = [], 0
        for i in range(count - 1):
            k = at
            d, at = _size(b, at, e)
            n = n + d - ((1 << 7 * (at - k) - 1) - 1) if i else d
            sizes.append(n)
        sizes.append(e - at - sum(sizes))
    elif kind == 4:
        if (e - at) % count:
            raise MatroskaError(f"fixed lace at {s} doesn't divide")
        sizes = [(e - at) // count] * count
    else:
        sizes = [e - at]
    if min(sizes) < 0:
        raise MatroskaError(f"lace at {s} is longer than its block")
    tick = m.tracks[track].default_ns if track in m.tracks else 0
    stamp, is_key = (start + relative) * m.scale, bool(flags & 0x80) if key is None else key
    for i, n in enumerate(sizes):
        m.packets.append((track, stamp + i * tick, is_key, at, n, i))
        at += n


def _track(b: bytes, s: int, e: int) -> Track:
    t = Track()
    for i, x, y in elements(b, s, e):
        if i == NUMBER:
            t.number = _uint(b, x, y)
        elif i == KIND:
            t.kind = _uint(b, x, y)
        elif i == CODEC:
            t.codec = b[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            t.default_ns = _uint(b, x, y)
        elif i == AUDIO:
            for j, p, q in elements(b, x, y):
                if j == FREQUENCY:
                    t.rate = _float(b, p, q)
                elif j == CHANNELS:
                    t.channels = _uint(b, p, q)
                elif j == DEPTH:
                    t.depth = _uint(b, p, q)
    return t


def parse(b: bytes) -> Media:
    m, head = Media(), False
    try:
        for ident, s, e in elements(b, 0, len(b)):
            if ident == EBML:
                head = True
            if ident != SEGMENT or not head:
                continue
            for i, x, y in elements(b, s, e):
                if i == INFO:
                    length = 0.0
                    for j, p, q in elements(b, x, y):
                        if j == SCALE:
                            m.scale = _uint(b, p, q)
                        elif j == DURATION:
                            length = _float(b, p, q)
                    m.duration_ns = length * m.scale
                elif i == TRACKS:
                    for j, p, q in elements(b, x, y):
                        if j == TRACK:
                            t = _track(b, p, q)
                            m.tracks[t.number] = t
                elif i == CLUSTER:
                    start = 0
                    m.clusters.append(x)
                    for j, p, q in elements(b, x, y):
                        if j == TIMESTAMP:
                            start = _uint(b, p, q)
                        elif j == SIMPLE_BLOCK:
                            _block(b, p, q, start, m, None)
                        elif j == BLOCK_GROUP:
                            inner = list(elements(b, p, q))
                            for k, u, v in inner:
                                if k == BLOCK:
                                    _block(b, u, v, start, m, all(z[0] != 0xFB for z in inner))  # no reference block: a key frame
                elif i == CUES:
                    for j, p, q in elements(b, x, y):
                        if j == CUE_POINT:
                            time = 0
                            for k, u, v in elements(b, p, q):
                                if k == CUE_TIME:
                                    time = _uint(b, u, v) * m.scale
                                elif k == CUE_POSITIONS:
                                    got = {g: _uint(b, w, z) for g, w, z in elements(b, u, v)}
                                    m.cues.append((time, got.get(CUE_TRACK, 0), s + got.get(CUE_CLUSTER, 0)))
    except (IndexError, struct.error) as x:
        raise MatroskaError(f"the file is cut off: {x}") from x
    if not head:
        raise MatroskaError("no EBML header")
    return m


def payload_of(b: bytes, m: Media, track: int) -> bytes:
    view = memoryview(b)
    return b"".join(view[at : at + n] for t, _, _, at, n, _ in m.packets if t == track)


def pad(text: bytes, to: int = FRAME) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // to)) * to - len(text))


def features(samples: bytes, m: Media) -> str:
    """Packets, length, mean, root mean square, zero crossings about 128, peak and entropy in bits of the samples."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    n = len(x)
    level = np.arange(256) - 128
    share = count[count > 0] / max(1, n)
    up = x >= 128
    seen = np.flatnonzero(count)
    return "packets=%d;ms=%d;mean=%.6f;rms=%.6f;crossings=%d;peak=%d;entropy=%.6f" % (
        len(m.packets), sum(m.tracks[p[0]].default_ns for p in m.packets if p[0] in m.tracks) // 1_000_000, (count * level).sum() / max(1, n), ((count * level * level).sum() / max(1, n)) ** 0.5,
        int(np.count_nonzero(up[1:] != up[:-1])), int(np.abs(level[seen]).max(initial=0)), -(share * np.log2(share)).sum() if n else 0.0)


def media_column(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media BINARY): each whole text as a file of one audio track."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(pad(x or b"")) for x in part.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["k", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, media binary").withColumnRenamed("k", key)


def packet_table(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet: key, packet, track, codec, time_ns, keyframe, byte_offset, byte_length, lace (its place there)."""
    names = ["k", "packet", "track", "codec", "time_ns", "keyframe", "byte_offset", "byte_length", "lace"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                try:
                    m = parse(b) if b is not None else Media()
                except MatroskaError:
                    continue
                n = len(m.packets)
                if not n:
                    continue
                track, stamp, is_key, at, size, place = zip(*m.packets, strict=True)
                key_col = pa.DictionaryArray.from_arrays(pa.array([0] * n, pa.int8()), batch.column(0).slice(i, 1)).cast(batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([key_col, pa.array(range(n), pa.int32()), pa.array(track, pa.int32()), pa.array([m.tracks[t].codec if t in m.tracks else None for t in track], pa.string()), pa.array(stamp, pa.int64()), pa.array(is_key), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(place, pa.int32())], names)

    kind = media.schema[key].dataType.simpleString()
    out = media.select(F.col(key).alias("k"), F.col(column).alias("m")).mapInArrow(run, f"k {kind}, packet int, track int, codec string, time_ns bigint, keyframe boolean, byte_offset bigint, byte_length int, lace int")
    return out.withColumnRenamed("k", key)


def digests(docs: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back and describe both. The file lives in the task only."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for raw in part.column(1).cast(pa.binary()).to_pylist():
                    raw = raw or b""
                    media = mux(pad(raw))
                    m = parse(media)
                    back = payload_of(media, m, 1)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back, m)))
                cols = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
