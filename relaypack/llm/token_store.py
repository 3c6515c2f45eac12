"""Token ids in bit-plane-shuffled binary files.

A file holds the ids of a run of documents in ascending id order. Ids are cut into blocks of ``BLOCK``; a block's ids
are transposed into byte planes (or bit planes), each plane is compressed with zstandard, and a chunk index at the end
names every plane's place. The documents' own ids and their numbers of tokens are in the file too. Layout, little-endian:

    "RPTS0002" | planes ... | document lists: byte planes of i64 ids, u8 null flags, u32 counts, compressed, up to DOCS documents each
    | index: per block u32 ids, u8 planes, u8 mode, u32 length of each plane; per document list u32 documents, u32 length
    | u64 offset of the document lists | u64 offset of the index | u32 blocks | u32 lists | u32 crc32 of the index | "RPTSEND2"

Files are written in the shared folder under a temporary name and renamed, so a task that runs twice leaves whole
files only; what failed tasks left is removed after the job. Documents are dealt to files by ranges of (id, hash of the text,
input partition), so neither the size of one source nor the rows of one id (null, say) decide how much a task holds.
A task keeps a block of ids, the counts of its file's documents and a bounded cache of words. Files hold about
``file_bytes`` of text at every size of the corpus, and nothing of them goes to the driver.

A null text counts as empty and has its end id only. Null ids come first, equal ids (repeated rows) follow each other
ordered by a hash of the text. An empty table writes no file. Extra columns don't matter. Texts are encoded whole.
The folder stays until its owner removes it: the returned frame reads it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.llm.common import blocks_for, materialize, shared_dir, text_bytes

MAGIC, END = b"RPTS0002", b"RPTSEND2"
TAIL = struct.Struct("<QQIII")
BLOCK, DOCS = 1 << 16, 1 << 16
BYTES, BITS = 0, 1
CACHE_WORDS = 600_000
#: Files whose sizes are summed before the sums are summed in turn.
GROUP = 1024


def planes_of(ids: np.ndarray, mode: int = BYTES) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first; planes above the highest id are left out."""
    x = np.ascontiguousarray(ids, "<u4")
    top = int(x.max(initial=0))
    if mode == BYTES:
        raw = x.view(np.uint8).reshape(-1, 4)
        return [raw[:, k].tobytes() for k in range((top.bit_length() + 7) // 8 or 1)]
    return [np.packbits((x >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(top.bit_length() or 1)]


def ids_of(planes: list[bytes], n: int, mode: int) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        if mode == BYTES:
            out |= np.frombuffer(plane, np.uint8, n).astype("<u4") << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return out


def documents_of(ids: list[int | None], counts: list[int], zstd: zstandard.ZstdCompressor) -> bytes:
    """A document list: byte planes of ids, null flags and counts."""
    known = np.array([i if i is not None else 0 for i in ids], "<i8")
    columns = (known, np.array([i is None for i in ids], np.uint8), np.array(counts, "<u4"))
    return zstd.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(ids), -1).T).tobytes() for c in columns))


class Writer:
    """Append documents, then ``close``."""

    def __init__(self, out, *, mode: int = BYTES, block: int = BLOCK, level: int = 3):
        self.out, self.mode, self.block = out, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.index: list[bytes] = []
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.lists: list[tuple[int, bytes]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)
        self.at = len(MAGIC)

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.total += len(ids)
        if len(self.ids) == DOCS:
            self._list()
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.rest)
            cut = len(every) // self.block * self.block
            for k in range(0, cut, self.block):
                self._put(every[k : k + self.block])
            self.rest, self.held = [every[cut:]], len(every) - cut

    def _list(self) -> None:
        self.lists.append((len(self.ids), documents_of(self.ids, self.counts, self.zstd)))
        self.ids, self.counts = [], []

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in planes_of(ids, self.mode)]
        self.index.append(struct.pack("<IBB", len(ids), len(packed), self.mode) + struct.pack(f"<{len(packed)}I", *map(len, packed)))
        for p in packed:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.rest))
        if self.ids:
            self._list()
        index = b"".join(self.index) + b"".join(struct.pack("<II", n, len(x)) for n, x in self.lists)
        lists = b"".join(x for _, x in self.lists)
        self.out.write(lists + index + TAIL.pack(self.at, self.at + len(lists), len(self.index), len(self.lists), zlib.crc32(index)) + END)


class Reader:
    """Random access to a file's blocks and document lists through its chunk index."""

    def __init__(self, f):
        self.f = f
        size = f.size() if hasattr(f, "size") else f.seek(0, 2)
        end = size - TAIL.size - len(END)
        f.seek(end)
        tail = f.read(TAIL.size + len(END))
        if tail[TAIL.size :] != END:
            raise ValueError("no token file, or its end is missing")
        lists_at, at, blocks, lists, crc = TAIL.unpack(tail[: TAIL.size])
        f.seek(at)
        index = f.read(end - at)
        if zlib.crc32(index) != crc:
            raise ValueError("the chunk index is damaged")
        #: (offset, ids, mode, lengths)
        self.chunks: list[tuple[int, int, int, tuple[int, ...]]] = []
        k, place = 0, len(MAGIC)
        for _ in range(blocks):
            n, planes, mode = struct.unpack_from("<IBB", index, k)
            lengths = struct.unpack_from(f"<{planes}I", index, k + 6)
            k += 6 + 4 * planes
            self.chunks.append((place, n, mode, lengths))
            place += sum(lengths)
        #: (offset, documents, length)
        self.lists: list[tuple[int, int, int]] = []
        for i in range(lists):
            n, length = struct.unpack_from("<II", index, k + 8 * i)
            self.lists.append((lists_at, n, length))
            lists_at += length
        self.zstd = zstandard.ZstdDecompressor()

    def block(self, i: int) -> np.ndarray:
        at, n, mode, lengths = self.chunks[i]
        self.f.seek(at)
        return ids_of([self.zstd.decompress(self.f.read(k)) for k in lengths], n, mode)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, null flags and token counts of the file's documents, a list at a time."""
        for at, n, length in self.lists:
            self.f.seek(at)
            raw = np.frombuffer(self.zstd.decompress(self.f.read(length)), np.uint8).reshape(13, n)
            ids, counts = (np.ascontiguousarray(raw[a:b].T).reshape(-1).view(kind) for a, b, kind in ((0, 8, "<i8"), (9, 13, "<u4")))
            yield ids, raw[8] != 0, counts.astype(np.int64)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.block(i) for i in range(len(self.chunks)))


# What ASCII lower-casing and white space make of a byte, and its kind: a letter, or a mark other than the apostrophe.
_LOWER = bytes(0x20 if i == 0x0A else i | 0x20 if 0x41 <= i <= 0x5A else i for i in range(256))
_LETTER = np.array([0x61 <= i <= 0x7A for i in range(256)])
_MARK = np.array([0x20 < i < 0x7F and not chr(i).isalnum() and i != 0x27 for i in range(256)])
#: Second bytes of the letters that 0xC3 begins.
_LATIN = np.array([0xA0 <= i <= 0xBF and i != 0xB7 for i in range(256)])


def pieces_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pieces of texts between white space and at edges of letters and marks, and where each text's begin in the list.

    A-Z are lower-cased, as the tokenizer does. An edge between a letter and a mark (no apostrophe) is one of the tokenizer's pattern.
    """
    b = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    plain, mark = _LETTER[b], _MARK[b]
    letter = plain.copy()
    letter[1:] |= _LATIN[b[1:]] & (b[:-1] == 0xC3)
    edge = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & plain[1:])) + 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    out = np.insert(b, edge, 0x20) if len(edge) else b
    blank = np.flatnonzero(out == 0x20)
    begin += np.searchsorted(edge, begin, "right")
    return out.tobytes().split(b" "), np.searchsorted(blank, np.r_[begin, len(out)])


class WordTokenizer:
    """The tokenizers library over pieces between spaces, each distinct piece encoded once.

    Normalizing and splitting are local to such pieces: white space is a boundary of the tokenizer's pattern and is
    dropped, and no character composes with a space. Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, many to a call: each makes one token with a word's end, its last, unless its case mapping makes marks."""
        out: list[bytes] = []
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        for group, e in zip(groups, self.t.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += self._ids(group)
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        special = {i for i, text in enumerate(texts) if b"<|" in text and any(s in text.decode() for s in self.special)}
        pieces, at = pieces_of([b"" if i in special else text for i, text in enumerate(texts)])
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        missing = set(pieces).difference(self.cache)
        plain: list[str] = []
        other: list[str] = []
        for x in missing:
            word = x.decode()
            (plain if word.isalpha() else other).append(word)
        for words, encode in ((plain, self._words), (other, self._ids)):
            for k in range(0, len(words), 8192):
                part = words[k : k + 8192]
                self.cache.update(zip(map(str.encode, part), encode(part), strict=True))
        ids = list(map(self.cache.__getitem__, pieces))
        return [self._ids([text.decode()])[0] if i in special else b"".join(ids[at[i] : at[i + 1]]) for i, text in enumerate(texts)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write(spark: SparkSession, docs: DataFrame, path: str, *, end_id: int = 1, mode: int = BYTES, file_bytes: int = 12 << 20) -> DataFrame:
    """Write the files; their manifest: file, its place in the order and the tokens in it."""
    total = docs.agg(F.sum(text_bytes())).first()[0] or 0
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, w, end = None, None, struct.pack("<I", end_id)
        place = TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            texts = batch.column(1).cast(pa.binary())
            ids = batch.column(0).to_pylist()
            size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            while at < len(ids):
                if w is None:
                    tok = tokenizer(path)
                    store, home = pafs.FileSystem.from_uri(folder)
                    name = f"{place:08d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{home}/.{name}")
                    w = Writer(sink, mode=mode)
                k, held = at, 0
                while k < len(ids) and held < 1 << 21:
                    held += size[k]
                    k += 1
                for i, x in enumerate(tok.encode([t or b"" for t in texts.slice(at, k - at).to_pylist()]), at):
                    w.append(ids[i], np.frombuffer(x + end, "<u4"))
                at = k
        if w is not None:
            w.close()
            sink.close()
            store.move(f"{home}/.{name}", f"{home}/{name}.rpts")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.rpts"]), pa.array([place], pa.int64()), pa.array([w.total], pa.int64())], ["file", "place", "n"])

    # ranges hold equal rows, not bytes: a file is a few times the mean at most, as lengths vary
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("part"))
    dealt = keyed.repartitionByRange(blocks_for(total, file_bytes), "doc_id", "tie", "part").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = materialize(spark, dealt.mapInArrow(run, "file string, place bigint, n bigint"), "manifest")
    for left in fs.get_file_info(pafs.FileSelector(base)):
        if left.base_name.startswith("."):
            fs.delete_file(left.path)
    return manifest


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The manifest names the files and their places only; a file's start is a running sum over groups of GROUP files, then in the group.
    """
    grouped = manifest.withColumn("g", F.floor(F.col("place") / GROUP))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row for GROUP files: 8,000 of them in 100 TB
    sums = grouped.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("g").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, "g").select("file", (F.col("first") + F.col("own")).alias("at"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = pafs.FileSystem.from_uri(file)
                with store.open_input_file(place) as f:
                    reader = Reader(f)
                    blocks, held = iter(reader), np.empty(0, "<u4")
                    for ids, null, counts in reader.documents():
                        crcs = []
                        for n in counts.tolist():
                            crc, need = 0, n
                            while need > len(held):
                                crc = zlib.crc32(held, crc)
                                need -= len(held)
                                held = next(blocks)
                            crcs.append(zlib.crc32(held[:need], crc))
                            held = held[need:]
                        begin = at + np.cumsum(counts) - counts
                        at += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(begin), pa.array(counts), pa.array(crcs, pa.int64())], names)

    files = materialize(spark, starts, "starts")
    return files.repartition(max(1, files.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
