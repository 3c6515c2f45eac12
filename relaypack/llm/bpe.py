"""Byte-level BPE by padded numpy matrices.

Words of like length share one matrix. In each round every row merges its leftmost pair of minimum rank: pairs are
looked up in an open-addressed hash table, rows are compacted by one column, and rows without a pair leave.

Nulls count as empty texts; an empty text has no ids. Repeated rows are encoded alike, extra columns are ignored by
the query and passed on by ``encode_column``. Texts are encoded whole, in Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaypack.llm.common import text_slices

NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words kept per Python worker; the cache is emptied beyond it and fills again.
CACHE_WORDS = 500_000
#: Bytes of text that are encoded at once.
PART = 1 << 21


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open addressing over (left id, right id) -> merged id, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        todo_k, todo_v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(todo_k)
        while len(todo_k):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.values[slot[won]] = todo_k[won], todo_v[won]
            todo_k, todo_v, slot = todo_k[~won], todo_v[~won], slot[~won] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.loose = re.compile(r" \s|\s ").search
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                n = len(word)
                buckets.setdefault(n if n <= 24 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, 2_000_000 // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        columns = np.arange(width)
        inside = columns[None, 1:] < length[:, None]
        rank = np.full((n, width), NONE, np.int32)  # the last column stays NONE, so that there always is a column
        rank[:, :-1][inside] = self.pairs.get(ids[:, :-1][inside], ids[:, 1:][inside])
        done: list[bytes] = [b""] * n
        row = np.arange(n)
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            best = rank[every, at]
            if (over := np.flatnonzero(best == NONE)).size:
                for k in over:
                    done[row[k]] = ids[k, : length[k]].astype("<u4").tobytes()
                live = np.flatnonzero(best != NONE)
                if not live.size:
                    break
                most = int(length[live].max())
                ids, rank, row, length, at, best = ids[live, :most], rank[live, :most], row[live], length[live], at[live], best[live]
            width = ids.shape[1]
            if len(row) <= 4:
                for k, j in enumerate(at.tolist()):
                    ids[k, j + 1 : -1] = ids[k, j + 2 :]
                    rank[k, j:-1] = rank[k, j + 1 :]
                ids, rank = ids[:, :-1], rank[:, :-1]
                self._merge(ids, rank, length := length - 1, at, best)
                continue
            moved = np.arange(width - 1)[None, :] > at[:, None]
            ids = np.where(moved, ids[:, 1:], ids[:, :-1])
            rank = np.where(moved, rank[:, 1:], rank[:, :-1])
            self._merge(ids, rank, length := length - 1, at, best)
        return done

    def _merge(self, ids: np.ndarray, rank: np.ndarray, length: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        """Put the merged ids into compacted rows and rank the pairs beside them anew."""
        every = np.arange(len(at))
        ids[every, at] = best
        rank[every, at] = NONE
        k = np.flatnonzero(at > 0)
        rank[k, at[k] - 1] = self.pairs.get(ids[k, at[k] - 1], ids[k, at[k]])
        k = np.flatnonzero(at + 1 < length)
        rank[k, at[k]] = self.pairs.get(ids[k, at[k]], ids[k, at[k] + 1])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each whole text as little-endian bytes.

        Where each space stands between other characters than white space, a match of the pattern never spans a space
        but as its first character: such texts are cut at spaces, and the pieces are cached. Others are split whole.
        """
        cut: list[tuple[str, list[str]] | list[str]] = []
        pieces: set[str] = set()
        words: set[str] = set()
        for text in texts:
            if self.loose(text):
                cut.append(found := self.split(text))
                words.update(found)
            else:
                first, *rest = text.split(" ")
                pieces.update(rest)
                words.update(head := self.split(first))
                cut.append((head, rest))
        if len(self.cache) + len(self.words) > CACHE_WORDS:
            self.cache, self.words = {}, {}
        new = {p: self.split(" " + p) for p in pieces.difference(self.cache)}
        for found in new.values():
            words.update(found)
        missing = list(words.difference(self.words))
        self.words.update(zip(missing, self.encode_words([w.encode() for w in missing]), strict=True))
        word, piece = self.words.__getitem__, self.cache.__getitem__
        self.cache.update((p, b"".join(map(word, found))) for p, found in new.items())
        for x in cut:
            yield b"".join(map(word, x)) if isinstance(x, list) else b"".join((*map(word, x[0]), *map(piece, x[1])))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids BINARY of little-endian uint32, decoded BINARY) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at, part in text_slices(batch.column(1), PART):
                ids = list(enc.encode(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.binary())], ["k", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids binary, decoded binary").withColumnRenamed("k", key)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the digests are made where the ids are, so that ids aren't moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at, part in text_slices(batch.column(1), PART):
                n, a, b = [], [], []
                for ids in enc.encode(part):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
