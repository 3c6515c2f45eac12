"""Substring dedup: words covered by a window that also starts in a document of smaller id go.

Five steps over blocks of documents, in one lazy plan; the exchange of texts by block is made once and reused. Rows are
dealt to blocks by their place in the input, so many rows of one id (null, say) or equal rows fill no block; ids are
compared, never blocks:

1. Each block makes its count-min sketch (two rows of cells) of the distinct windows of its documents, saturated at
   two, kept sparse: sorted cells, packed by byte planes.
2. Sketches are merged by ranges of cells. Merged counts overestimate; each block gets back its cells that count two
   or more.
3. Each block sends the windows whose cells all count two or more, with the least id that has them, by hash range.
4. Equal windows are grouped; blocks learn which of theirs start in a smaller document elsewhere. Windows are told apart by
   112-bit hashes, not by their words: two of 10**13 different ones (100 TB) agree with a chance of about 1e-8.
5. Each block marks the covered words and joins what is left.

A window is sent once per block, however often it occurs, so a passage in a third of all documents is no hot key;
nothing is broadcast or collected. A sketch and a group of windows hold what one block-sized range holds. A task takes
about 25 times its block's bytes: 100 MB for 4 MB blocks.

Nulls: a null text has no words. A null id counts as larger than all others. Rows of equal id don't remove each
other's words. Texts of fewer words than a window stay whole. Windows are
judged on the input. An empty table gives an empty result. With ``text_out`` extra columns stay; a column n_removed is replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaypack.llm.common import text_bytes

WINDOW = 13
BLOCK = "__relaypack_block"
#: Least bytes of a block, and bytes of what a block sends to a range at least: blocks and ranges meet pairwise.
BLOCK_BYTES, SENT_BYTES = 4 << 20, 1400
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_ROWS = (np.uint64(1), np.uint64(0xC2B2AE3D27D4EB4F))
_NO_ID = np.iinfo(np.int64).max
_BYTE = np.random.default_rng(20240607).integers(1, 2**64, (2, 256), np.uint64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of a block's documents, in the order of their ids: byte ranges, document and hashes."""

    def __init__(self, table: pa.Table, lanes: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, np.int64)
        self.order = np.argsort(self.ids, kind="stable")
        self.ids = self.ids[self.order]
        texts = table.column("text").cast(pa.binary()).to_pylist()
        texts = [texts[i] or b"" for i in self.order]
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length + 1) - length - 1
        del texts
        starts, ends, hashes = [], [], [[] for _ in range(lanes)]
        at, n = 0, len(self.buffer)
        place = np.int32 if n < 1 << 31 else np.int64
        while at < n:
            stop = min(n, at + PIECE)
            if stop < n:  # a piece ends after white space
                while True:
                    back = np.flatnonzero(_SPACE[self.buffer[at:stop]])
                    if len(back) or stop == n:
                        break
                    stop = min(n, stop + PIECE)
                stop = at + int(back[-1]) + 1
            b = self.buffer[at:stop]
            space = _SPACE[b]
            edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
            s, e = edge[::2], edge[1::2]
            up, down = _power(len(b))
            for k in range(lanes):
                total = np.empty(len(b) + 1, np.uint64)
                total[0] = 0
                np.cumsum(_BYTE[k][b] * up, out=total[1:])
                hashes[k].append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append((s + at).astype(place))
            ends.append((e + at).astype(place))
            at = stop
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.words = [np.concatenate(x) for x in hashes]
        cut = np.searchsorted(self.starts, first)
        self.first_word = np.r_[cut, len(self.starts)]
        self.n_words = np.diff(self.first_word)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Word place, document and a hash a lane of every window."""
        n = len(self.starts) - width + 1
        if n <= 0:
            none = np.empty(0, np.int64)
            return none, none, [np.empty(0, np.uint64) for _ in self.words]
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        lanes = []
        for k, h in enumerate(self.words):
            w = np.zeros(n, np.uint64)
            for j in range(width):
                w *= _STEP[k]
                w += h[j : j + n]
            lanes.append(mix(w[at]))
        return at, doc[at], lanes


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of each array, compressed; sorted arrays are best given as differences."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T).tobytes() for a in arrays) if n else b""
    return n.to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw, at, out = zstandard.ZstdDecompressor().decompress(data[4:]), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(-1, n) if n else np.empty((np.dtype(kind).itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def _differ(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _cell(w: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (w * _ROWS[row]) >> np.uint64(64 - bits)


def _split(cells: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Bounds of each shard's run in sorted cells."""
    edge = (np.arange(shards + 1, dtype=object) * (1 << bits) // shards).astype(np.uint64)
    return np.searchsorted(cells, edge)


def _sketch(width: int, bits: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block = table.column(BLOCK)[0].as_py()
        b = Block(table, 1)
        _, doc, (w,) = b.windows(width)
        order = np.argsort(w, kind="stable")
        w, ids = w[order], b.ids[doc[order]]
        own = _runs(w, ids)  # a window counts once a document
        w = w[own]
        shard, payload = [], []
        for row in range(len(_ROWS)):
            cells = np.sort(_cell(w, row, bits))
            at = _runs(cells)
            count = np.minimum(np.diff(np.r_[at, len(cells)]), 2)
            cells = cells[at]
            bound = _split(cells, bits, shards)
            for s in range(shards):
                c = cells[bound[s] : bound[s + 1]]
                if len(c):
                    shard.append(row * shards + s)
                    payload.append(pack(_differ(c), count[bound[s] : bound[s + 1]].astype(np.uint8)))
        return pa.table({"shard": pa.array(shard, pa.int64()), "block": pa.array([block] * len(shard), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One shard of the merged sketch: to each block its cells that count two or more."""
    blocks, parts, counts = table.column("block").to_pylist(), [], []
    for data in table.column("payload"):
        d, n = unpack(data.as_py(), np.uint64, np.uint8)
        parts.append(np.cumsum(d, dtype=np.uint64))
        counts.append(n)
    cells, count = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(cells, kind="stable")
    at = _runs(cells[order])
    total = np.add.reduceat(count[order].astype(np.int64), at)
    many = np.empty(len(cells), bool)
    many[order] = np.repeat(total >= 2, np.diff(np.r_[at, len(cells)]))
    out, k = [], 0
    for p in parts:
        out.append(pack(_differ(p[many[k : k + len(p)]])))
        k += len(p)
    n = len(blocks)
    return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array(table.column("shard").to_pylist(), pa.int64()), "payload": pa.array(out, pa.binary())}) if n else table.select(["block", "shard", "payload"])


def _in(cells: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(cells), bool)
    at = np.searchsorted(among, cells)
    at[at == len(among)] = 0
    return among[at] == cells


def _short(v: np.ndarray) -> np.ndarray:
    """48 bits of a second hash; with the 64 of the first, a window's name."""
    return v >> np.uint64(16)


def _halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v.astype(np.uint32), (v >> np.uint64(32)).astype(np.uint16)


def _whole(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return hi.astype(np.uint64) << np.uint64(32) | lo


def _exact(width: int, bits: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's windows that the sketch estimates at two or more, with the least id that has them."""

    def run(docs: pa.Table, seen: pa.Table) -> pa.Table:
        shard, payload, block = [], [], None
        if docs.num_rows and seen.num_rows:
            block = docs.column(BLOCK)[0].as_py()
            rows: list[list[tuple[int, bytes]]] = [[] for _ in _ROWS]
            for s, data in zip(seen.column("shard").to_pylist(), seen.column("payload").to_pylist(), strict=True):
                rows[s // shards].append((s, data))
            b = Block(docs, 2)
            _, doc, (w, v) = b.windows(width)
            ok = np.ones(len(w), bool)
            for row, parts in enumerate(rows):
                cells = np.concatenate([np.cumsum(unpack(p, np.uint64)[0], dtype=np.uint64) for _, p in sorted(parts)] or [np.empty(0, np.uint64)])
                live = np.flatnonzero(ok)
                ok[live] = _in(_cell(w[live], row, bits), cells)
            w, v, ids = w[ok], _short(v[ok]), b.ids[doc[ok]]
            order = np.lexsort((ids, v, w))
            w, v, ids = w[order], v[order], ids[order]
            at = _runs(w, v)
            w, v, ids = w[at], v[at], ids[at]
            bound = _split(w >> np.uint64(64 - bits), bits, shards)
            for s in range(shards):
                k = slice(bound[s], bound[s + 1])
                if bound[s] < bound[s + 1]:
                    shard.append(s)
                    payload.append(pack(_differ(w[k]), *_halves(v[k]), ids[k]))
        return pa.table({"shard": pa.array(shard, pa.int64()), "block": pa.array([block] * len(shard), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _least(table: pa.Table) -> pa.Table:
    """Equal windows of all blocks: to each block those that start in a smaller document elsewhere."""
    blocks, ws, vs, idss = table.column("block").to_pylist(), [], [], []
    for data in table.column("payload"):
        d, lo, hi, ids = unpack(data.as_py(), np.uint64, np.uint32, np.uint16, np.int64)
        ws.append(np.cumsum(d, dtype=np.uint64))
        vs.append(_whole(lo, hi))
        idss.append(ids)
    w, v, ids = np.concatenate(ws), np.concatenate(vs), np.concatenate(idss)
    order = np.lexsort((ids, v, w))
    at = _runs(w[order], v[order])
    least = np.empty(len(w), np.int64)
    least[order] = np.repeat(ids[order][at], np.diff(np.r_[at, len(w)]))
    elsewhere = least < ids
    to, out, k = [], [], 0
    for block, p in zip(blocks, ws, strict=True):
        m = elsewhere[k : k + len(p)]
        if m.any():
            to.append(block)
            out.append(pack(_differ(p[m]), *_halves(v[k : k + len(p)][m])))
        k += len(p)
    return pa.table({"block": pa.array(to, pa.int64()), "payload": pa.array(out, pa.binary())})


def _covered(b: Block, found: pa.Table, width: int) -> np.ndarray:
    """Which words go."""
    at, doc, (w, v) = b.windows(width)
    v = _short(v)
    gone = np.zeros(len(w), bool)
    # windows that start in a smaller document of this block
    order = np.lexsort((doc, v, w))
    sw, sv, ids = w[order], v[order], b.ids[doc[order]]
    run = _runs(sw, sv)
    gone[order] = np.repeat(ids[run] if len(run) else ids, np.diff(np.r_[run, len(w)])) < ids
    parts = [unpack(p, np.uint64, np.uint32, np.uint16) for p in found.column("payload").to_pylist()]
    if parts:
        fw = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _, _ in parts])
        fv = np.concatenate([_whole(lo, hi) for _, lo, hi in parts])
        maybe = np.flatnonzero(_in(w, np.sort(fw)) & ~gone)
        # both halves: ranks of the pairs among the found ones
        key = np.rec.fromarrays([np.r_[fw, w[maybe]], np.r_[fv, v[maybe]]])
        order = np.lexsort((key.f1, key.f0))
        run = _runs(key.f0[order], key.f1[order])
        has = np.maximum.reduceat((order < len(fw)).astype(np.int8), run) if len(run) else np.empty(0, np.int8)
        hit = np.empty(len(key), bool)
        hit[order] = np.repeat(has > 0, np.diff(np.r_[run, len(key)]))
        gone[maybe] |= hit[len(fw) :]
    step = np.zeros(len(b.starts) + width + 1, np.int32)
    np.add.at(step, at[gone], 1)
    np.add.at(step, at[gone] + width, -1)
    return np.cumsum(step)[: len(b.starts)] > 0


def _kept(b: Block, gone: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Words removed per document; kept words of all documents with a space after each; where each document's begin."""
    total = np.r_[0, np.cumsum(gone)]
    removed = total[b.first_word[1:]] - total[b.first_word[:-1]]
    keep = ~gone
    mark = np.zeros(len(b.buffer) + 2, np.int8)
    mark[b.starts[keep]] += 1
    mark[b.ends[keep] + 1] -= 1
    inside = np.cumsum(mark[: len(b.buffer)], dtype=np.int8) > 0
    out = b.buffer[inside]
    out = np.where(_SPACE[out], np.uint8(0x20), out)
    size = np.r_[0, np.cumsum(np.where(keep, b.ends - b.starts + 1, 0))]
    return removed, out.tobytes(), size[b.first_word]


def _finish(width: int, text_out: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            docs = docs.slice(0, 0)
        b = Block(docs, 2)
        removed, kept, at = _kept(b, _covered(b, found, width))
        n = len(b.order)
        if not text_out:
            sha = [hashlib.sha256(kept[at[i] : max(at[i], at[i + 1] - 1)]).hexdigest() for i in range(n)]
            return pa.table({"doc_id": docs.column("doc_id").take(pa.array(b.order)) if n else docs.column("doc_id"), "n_words": pa.array(b.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})
        back = np.zeros(n, np.int64)
        back[b.order] = removed
        # only texts that lose words are made anew
        fresh = {int(b.order[i]): kept[at[i] : max(at[i], at[i + 1] - 1)] for i in np.flatnonzero(removed)}
        column = docs.column("text").cast(pa.string()).combine_chunks()
        if fresh:
            column = pc.replace_with_mask(column, pa.array(back > 0), pa.array([fresh[k] for k in sorted(fresh)], pa.binary()).cast(pa.string()))
        out = docs.set_column(docs.column_names.index("text"), "text", column).drop_columns([BLOCK])
        return out.append_column("n_removed", pa.array(back, pa.int64()))

    return run


def dedup(spark: SparkSession, docs: DataFrame, *, width: int = WINDOW, block_bytes: int | None = None, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``text_out`` all columns of ``docs``, the kept text in place of the text, and n_removed.

    Texts that lose no word stay as they are. ``block_bytes`` bounds what a task holds, but for one longer text. Blocks and ranges
    meet pairwise, as the map and reduce sides of any exchange do, so what one sends another is held at ``SENT_BYTES`` or more and
    blocks grow with the root of the corpus: 4 MB up to 12 GB of text, 37 MB for 1 TB, 374 MB for 100 TB. Results don't depend on it.
    """
    total = docs.agg(F.sum(text_bytes())).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bytes = block_bytes or max(BLOCK_BYTES, math.isqrt(SENT_BYTES * total))
    blocks = max(1, -(-total // block_bytes), min(parts, total >> 20))
    bits = max(12, min(56, (8 * total // 6).bit_length()))  # a word has six bytes or so: eight cells a window
    held = docs.drop("n_removed") if text_out else docs.select("doc_id", "text")
    by_block = held.withColumn(BLOCK, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))
    left = by_block.groupBy(BLOCK)
    sketch = left.applyInArrow(_sketch(width, bits, blocks), "shard long, block long, payload binary")
    seen = sketch.groupBy("shard").applyInArrow(_merge, "block long, shard long, payload binary")
    exact = left.cogroup(seen.groupBy("block")).applyInArrow(_exact(width, bits, blocks), "shard long, block long, payload binary")
    found = exact.groupBy("shard").applyInArrow(_least, "block long, payload binary")
    if not text_out:
        return left.cogroup(found.groupBy("block")).applyInArrow(_finish(width, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    schema = T.StructType([*held.schema.fields, T.StructField("n_removed", T.LongType())])
    return left.cogroup(found.groupBy("block")).applyInArrow(_finish(width, True), schema)
