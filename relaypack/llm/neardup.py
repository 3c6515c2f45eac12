"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation, components.

1. Each text's shingle set gets a one-permutation MinHash signature with optimal densification. Documents of the same words in
   the same order (lower-cased; by a 128-bit BLAKE2 digest of all of them) form a class, whose smallest id goes on for all of them.
   Equal sets of other texts are confirmed as any other pair is.
2. Bands of the signature form buckets. Each member of a bucket meets its smallest member only, so a bucket of any
   size gives one candidate pair a member.
3. Signatures of candidates are compared batch by batch. After n positions with m matches the similarity is
   Beta(m + 1, n - m + 1); a pair goes as soon as the chance that it reaches the threshold is below ``miss``.
4. Survivors are confirmed on their full sets of words, not on hashes. Links give components.
5. Buckets that still hold several components are searched for links between these: their members meet block by
   block. Those that the same test leaves a pair are confirmed block by block on full sets, by postings; a block gives
   one link for two components, so pairs are never written out and no connection is lost to step 2. A block holds two
   chunks of about ``CHUNK`` members.

With the default bands a pair at the threshold shares none with a chance of about 3e-6; above it less.

A null text, or one without words, has an empty set and is linked with nothing. A text of fewer words than a shingle
is one shingle. A null id is linked with nothing, its component is null and the row is kept. Repeated rows share a
component. An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.llm.common import materialize
from relaypack.llm.substring import Block, mix

BANDS, ROWS = 42, 6
SIZE = BANDS * ROWS
BATCH = 36
CHUNK = 512
PART_BYTES = 1 << 20


def shingle_set(text: bytes | None, k: int) -> set[tuple[bytes, ...]]:
    """The exact set: A-Z lower-cased, words between ASCII white space."""
    words = (text or b"").lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (text, hash), sorted; bounds of each text's run."""
    b = Block(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary())}), 1)
    _, doc, (w,) = b.windows(k)
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < k))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            live = b.n_words[short] > j
            one[live] = mix(one[live] * np.uint64(0xA0761D6478BD642F) + b.words[0][b.first_word[short[live]] + j] + np.uint64(j + 1))
        doc, w = np.r_[doc, short], np.r_[w, one]
    order = np.lexsort((w, doc))
    doc, w = doc[order], w[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    doc, w = doc[new], w[new]
    return doc, w, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(doc: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """uint16 matrix (n, SIZE): one-permutation MinHash, empty places filled by optimal densification."""
    h = mix(w ^ np.uint64(0x5851F42D4C957F2D))
    place = ((h >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
    least = np.full(n * SIZE, 2**32 - 1, np.uint64)
    np.minimum.at(least, doc * SIZE + place.astype(np.int64), h & np.uint64(2**32 - 2))
    least = least.reshape(n, SIZE)
    filled = least != 2**32 - 1
    out = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    some = filled.any(axis=1)
    row, col = np.nonzero(~filled & some[:, None])
    step = 0
    base = out.copy()
    while len(row):
        step += 1
        take = (mix(col.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step)) % np.uint64(SIZE)).astype(np.int64)
        hit = filled[row, take]
        out[row[hit], col[hit]] = base[row[hit], take[hit]]
        row, col = row[~hit], col[~hit]
    return out


def needed_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(positions compared, fewest matches to go on) after each batch."""
    from math import comb

    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, need: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two like signature matrices survive the sequential test."""
    live = np.arange(len(a))
    match = np.zeros(len(a), np.int64)
    at = 0
    for n, least in need:
        match[live] += np.count_nonzero(a[live, at:n] == b[live, at:n], axis=1)
        live = live[match[live] >= least]
        at = n
        if not len(live):
            break
    return live


def _describe(docs: DataFrame, k: int) -> DataFrame:
    names = ["doc_id", "n_shingles", "same", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.empty(0)
            group = np.cumsum(size) // PART_BYTES
            edge = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(texts)] if len(texts) else []
            for at, end in zip(edge, edge[1:], strict=False):
                part = [(x or b"").lower() for x in texts.slice(at, end - at).to_pylist()]
                doc, w, bound = _hashes(part, k)
                sig = signatures(doc, w, len(part))
                count = np.diff(bound)
                same = [hashlib.blake2b(b" ".join(x.split()), digest_size=16).digest() if count[i] else None for i, x in enumerate(part)]
                rows = [s.tobytes() if count[i] else None for i, s in enumerate(sig)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(count, pa.int64()), pa.array(same, pa.binary()), pa.array(rows, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, same binary, sig binary")


def _bands() -> Column:
    """Array of band keys of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * F.lit(2 * ROWS) + F.lit(1), F.lit(2 * ROWS))))


def _prune(pairs: DataFrame, sigs: DataFrame, need: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b) that survive the sequential test."""
    wide = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SIZE) for i in (2, 3))
            live = pa.array(survivors(x, y, need))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(live), batch.column(1).take(live)], ["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet: 100 * intersection >= percent * union."""
    wide = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[int, set]] = {}  # the pairs of one smaller document mostly follow each other
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            ok = []
            for i, (p, q) in enumerate(zip(a, b, strict=True)):
                sets = []
                for side, ident, col in ((0, p, ta), (1, q, tb)):
                    if side not in last or last[side][0] != ident:
                        last[side] = (ident, shingle_set(col[i].as_py(), k))
                    sets.append(last[side][1])
                x, y = sets
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    ok.append(i)
            live = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(live), batch.column(1).take(live)], ["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): the smallest id reachable. Least neighbours and pointer jumps, a table a round."""
    both = materialize(spark, links.union(links.select("b", "a")).distinct(), "links")
    label = materialize(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("comp")), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        near = materialize(spark, near, "near")
        new = materialize(spark, label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "step")
        jump = new.join(new.select(F.col("id").alias("comp"), F.col("comp").alias("next")), "comp").select("id", "was", F.least("comp", "next").alias("comp"))
        label = materialize(spark, jump, "labels")
        if label.where("comp <> was").isEmpty():
            return label.select("id", "comp")


def _dealt(members: DataFrame, *columns: str) -> DataFrame:
    """Deal a bucket's members (key, n, id, ...) to pairs of chunks: each member meets every chunk of its bucket."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "comp", *columns)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    ids, comp, mine = (table.column(c).to_numpy() for c in ("id", "comp", "mine"))
    return ids, comp, np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j


def _open_members(members: DataFrame, need: list[tuple[int, int]]) -> DataFrame:
    """(key, id) of members (with band, sig) that a pair with another component survives the test in. A pair counts in the first bucket it shares."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, left, right, same = _sides(table)
        band = table.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SIZE)
        rows = sig[:, : band * ROWS].reshape(len(sig), band, ROWS)
        live = np.zeros(len(ids), bool)
        for x in left:
            y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) | (not same))]
            y = y[survivors(np.broadcast_to(sig[x], (len(y), SIZE)), sig[y], need)]
            if len(y) and band:
                y = y[~(rows[y] == rows[x]).all(axis=2).any(axis=1)]
            live[y] = True
            live[x] |= len(y) > 0
        return pa.table({"key": table.column("key").filter(pa.array(live)), "id": table.column("id").filter(pa.array(live))})

    return _dealt(members, "band", "sig").groupBy("key", "i", "j").applyInArrow(run, "key long, id long").distinct()


def _block_links(members: DataFrame, k: int, percent: int) -> DataFrame:
    """One exact link (a, b) for each two components that are linked within two chunks of a bucket; ``members`` has the texts."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, left, right, same = _sides(table)
        number: dict[tuple[bytes, ...], int] = {}
        sets = [np.array([number.setdefault(g, len(number)) for g in shingle_set(t, k)], np.int64) for t in table.column("text").cast(pa.binary()).to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([sets[y] for y in right]) if len(right) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(flat, kind="stable")
        owner, start = owner[order], np.searchsorted(flat[order], np.arange(len(number) + 1))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for x in left:
            g = sets[x]
            both = np.bincount(np.concatenate([owner[start[z] : start[z + 1]] for z in g]), minlength=len(right)) if len(g) else np.zeros(len(right), np.int64)
            ok = (comp[right] != comp[x]) & (both > 0) & (100 * both >= percent * (size[x] + size[right] - both))
            for y in right[ok]:
                pair = (min(ids[x], ids[y]), max(ids[x], ids[y]))
                found.setdefault((min(comp[x], comp[y]), max(comp[x], comp[y])), pair)
        a, b = ([p[z] for p in found.values()] for z in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _dealt(members, "text").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    need = needed_matches(percent / 100, miss)
    told = materialize(spark, _describe(docs, shingle), "signatures")
    real = told.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = materialize(spark, classes.where("n > 1").select("same", "first"), "classes")
    named = told.join(shared, "same", "left").select("doc_id", "n_shingles", "sig", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("id"))
    named = materialize(spark, named, "named")
    sigs = named.where("id = doc_id").select("id", "sig")
    bucket = sigs.select("id", F.posexplode(_bands()).alias("band", "key"))
    centers = materialize(spark, bucket.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centers")
    # members of shared buckets only; most keys are of one document
    shared_rows = materialize(spark, bucket.join(centers, "key"), "buckets")
    stars = materialize(spark, shared_rows.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # always by a merge join: the plan is the same at every size
    texts = materialize(spark, docs.select(F.col("doc_id").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi"), "texts")
    links = materialize(spark, _confirm(_prune(stars, sigs, need), texts, shingle, percent), "links")
    label = components(spark, links)
    # what stars left out: buckets of three or more with members of several components
    inside = materialize(spark, shared_rows.where("n > 2").join(label, "id", "left").select("key", "band", "n", "id", F.coalesce("comp", "id").alias("comp")), "inside")
    mixed = materialize(spark, inside.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "mixed")
    members = inside.join(mixed, "key").join(sigs, "id").select("key", "band", "n", "id", "comp", "sig")
    open_ = materialize(spark, _open_members(members, need), "open")
    counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    again = open_.join(materialize(spark, counts, "counts"), "key").join(label, "id", "left").join(texts, "id").select("key", "n", "id", F.coalesce("comp", "id").alias("comp"), "text")
    more = materialize(spark, _block_links(again, shingle, percent), "more")
    if not more.isEmpty():
        label = components(spark, links.union(more))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "id")).otherwise(F.col("doc_id"))
    out = named.join(label, "id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
