"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies four pieces of evidence:

* the text: byte trigrams of the lower-cased letters under a multinomial model of each language, tempered to ``EVIDENCE`` trigrams
  at most, since neighbours are not independent: with 60, posteriors of texts that differ from their label's model in a few
  words only are still below 1, and other evidence can be heard; texts are read whole whatever their length;
  a uniform model stands for "und", any other language or none;
* the declared markup language, right with a chance of ``DECLARED``;
* the address suffix and the host: soft counts of the text evidence, summed by suffix and by host, each smoothed by the
  level above (host by suffix, suffix by all rows). A row's own count is left out of its prior.

The models are fitted on at most ``SAMPLE`` labelled rows of each label, those of least id hash; everything else covers all
rows. Every label has a model (256 KB each, sent to all executors), so labels are to be languages: more than ``LABELS`` of them raise an error.
Hosts and suffixes are grouped with partial sums, so a host with a third of all rows is no hot key, and their join is
left to Spark, which broadcasts it only if it is small and splits hot keys else.

A null text counts as empty; a text without letters has no text evidence and is rejected as "und". A null host, suffix
or declaration gives no such evidence. Ties go to the language first by code. Repeated rows are judged alike. Without a
labelled row every text is "und". Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.llm.common import materialize, text_slices
from relaypack.llm.html_density import visible_text

SAMPLE = 500
LABELS = 1000
BITS = 16
EVIDENCE = 60.0
DECLARED = 0.9
HOST_WEIGHT, SUFFIX_WEIGHT, COUNTRY_WEIGHT = 10.0, 50.0, 5.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.01
PART = 1 << 18
#: Model entries gathered at once.
CELLS = 1 << 20
COUNTRY = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "gr": "el", "cz": "cs", "tr": "tr", "kr": "ko"}
_LETTER = np.full(256, 0x20, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = range(ord("a"), ord("z") + 1)
_LETTER[0x80:] = range(0x80, 0x100)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams (2**BITS: none) of texts with a space at each end, and where each text's begin. None reaches into the next text."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    b = _LETTER[np.frombuffer(b"".join(raw) + b"  ", np.uint8)]
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    blank = b == 0x20
    bucket[blank[1:-1]] = 1 << BITS  # a letter stands in the middle, so a text of one letter has one
    return bucket, np.cumsum(size) - size


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts, "<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def fit(labelled: DataFrame, *, key: str, text: str, label: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, "und" last, and the log-likelihood of each bucket under each: (2**BITS + 1, languages)."""
    hashed = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, F.col(label).cast("string").alias("label"), F.xxhash64(F.lit(11), key).alias("h"))
    sizes = hashed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if sizes.count() > LABELS:
        raise ValueError(f"more than {LABELS} labels: these are no languages")
    # about twice the sample by hash, so that no label's rows are sorted together but those few; then the least of them
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    few = hashed.join(F.broadcast(sizes), "label").where(share * F.col("n") <= 2 * sample + 50)
    first = F.row_number().over(Window.partitionBy("label").orderBy("h", key))
    ids = few.withColumn("i", first).where(F.col("i") <= sample).select(key).distinct()
    some = labelled.select(key, F.col(label).cast("string").alias("label"), F.col(text).alias("text")).join(F.broadcast(ids), key).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0), batch.column(1), strict=True):
                name, t = name.as_py(), t.as_py()
                if name is not None and t:
                    sums.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                    np.add.at(sums[name], trigrams([t])[0], 1)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([_packed(v) for v in sums.values()], pa.binary())], ["label", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py()) for x in t.column("counts"))
        return pa.table({"label": t.column("label").slice(0, 1), "counts": pa.array([_packed(total)], pa.binary())})

    # some 50 KB a language
    rows = some.mapInArrow(count, "label string, counts binary").groupBy("label").applyInArrow(add, "label string, counts binary").collect()
    counts = {r.label: _unpacked(r.counts)[:-1].astype(float) for r in rows}
    names = sorted(counts)
    size = 1 << BITS
    pooled = sum((counts[n] for n in names), np.zeros(size))
    back = 0.5 * pooled / max(1.0, pooled.sum()) + 0.5 / size
    model = np.zeros((size + 1, len(names) + 1), np.float32)
    for i, n in enumerate(names):
        model[:-1, i] = np.log((counts[n] + 200 * back) / (counts[n].sum() + 200))
    model[:-1, -1] = -np.log(size) - 1.0  # a little below uniform: in doubt a text is kept
    return [*names, UNKNOWN], model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _base(languages: list[str]) -> np.ndarray:
    """Prior of each language without other evidence."""
    return np.array([UNKNOWN_PRIOR if x == UNKNOWN else (1 - UNKNOWN_PRIOR) / max(1, len(languages) - 1) for x in languages])


def _sums(model: np.ndarray, bucket: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The model's rows summed text by text, CELLS of them at once."""
    total, step = np.zeros((len(start), model.shape[1])), max(1, CELLS // model.shape[1])
    for at in range(0, len(bucket), step):
        end = min(len(bucket), at + step)
        lo, hi = np.searchsorted(start, (at, end - 1), "right") - (1, 0)
        total[lo:hi] += np.add.reduceat(model[bucket[at:end]], np.maximum(start[lo:hi] - at, 0), axis=0, dtype=np.float64)
    return total


def likelihoods(rows: DataFrame, languages: list[str], model: np.ndarray, read: Callable[[str], str] | None = None) -> DataFrame:
    """id, host, suffix, declared, n (letter trigrams), x (log of text and declared evidence), p (its posterior, zeros without letters).

    ``read`` makes a text of what the text column holds, in the same worker: a function before this one would be a second worker for each task.
    """
    names = ["id", "host", "suffix", "declared", "n", "x", "p"]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # (2**BITS + 1) x (LABELS + 1) floats at most: 256 MB; 1.3 MB for four languages
    place = {lang: i for i, lang in enumerate(languages) if lang != UNKNOWN}
    k = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, part in text_slices(batch.column(4), PART):
                if read:
                    part = list(map(read, part))
                bucket, start = trigrams(part)
                total = _sums(model, bucket, start)
                n = np.add.reduceat((bucket < 1 << BITS).astype(np.int64), start)
                x = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                said = np.array([place.get(d, -1) for d in batch.column(3).slice(at, len(part)).to_pylist()])
                heard = np.flatnonzero(said >= 0)
                x[heard] += np.log((1 - DECLARED) / max(1, k - 1))
                x[heard, said[heard]] += np.log(DECLARED) - np.log((1 - DECLARED) / max(1, k - 1))
                p = _softmax(x + np.log(_base(languages))) * (n > 0)[:, None]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(part)) for i in range(4)), pa.array(n), _lists(x), _lists(p)], names)

    return rows.select("id", "host", "suffix", "declared", "text").mapInArrow(run, "id bigint, host string, suffix string, declared string, n bigint, x array<double>, p array<double>")


def identify(spark: SparkSession, rows: DataFrame, languages: list[str], model: np.ndarray, *, key: str, read: Callable[[str], str] | None = None) -> DataFrame:
    """key, language, probability, text_language, accepted, n_trigrams, host, suffix, declared for each row of ``rows`` (id, text, host, suffix, declared)."""
    told = materialize(spark, likelihoods(rows, languages, model, read), "likelihoods")
    k = len(languages)
    sums = F.array(*(F.sum(F.col("p")[i]) for i in range(k)))
    by_host = materialize(spark, told.where("host is not null").groupBy("host").agg(sums.alias("by_host")), "hosts")
    by_suffix = materialize(spark, told.where("suffix is not null").groupBy("suffix").agg(sums.alias("by_suffix")), "suffixes")
    every = np.array(told.agg(sums.alias("all")).first()[0], float)
    every = np.where(np.isnan(every), 0.0, every)
    wide = told.join(by_host, "host", "left").join(by_suffix, "suffix", "left").select("id", "host", "suffix", "declared", "n", "x", "p", "by_host", "by_suffix")
    country = {c: languages.index(lang) for c, lang in COUNTRY.items() if lang in languages}
    names = ["id", "host", "suffix", "declared", "n_trigrams", "language", "probability", "text_language", "accepted"]
    codes = np.array(languages, dtype=object)

    def rows_of(col: pa.Array) -> np.ndarray:
        return np.array([v if v is not None else (0.0,) * k for v in col.to_pylist()], float).reshape(-1, k)

    step = max(1, CELLS // (8 * k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            n = batch.column(4).to_numpy()
            x, own, host, suffix = (rows_of(batch.column(i)) for i in range(5, 9))
            above = (np.maximum(every - own, 0) + 1) / (np.maximum(every - own, 0) + 1).sum(axis=1, keepdims=True)
            suffix = np.maximum(suffix - own, 0)
            for i, c in enumerate(batch.column(2).to_pylist()):
                if c is not None and c.lower() in country:
                    suffix[i, country[c.lower()]] += COUNTRY_WEIGHT
            level = (suffix + SUFFIX_WEIGHT * above) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
            host = np.maximum(host - own, 0)
            prior = (host + HOST_WEIGHT * level) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            q = _softmax(x + np.log(prior))
            best, heard = q.argmax(axis=1), n > 0
            language = np.where(heard, codes[best], UNKNOWN)
            text = np.where(heard, codes[(x + np.log(_base(languages))).argmax(axis=1)], UNKNOWN)
            chance = np.where(heard, q[np.arange(len(q)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(language, pa.string()), pa.array(chance), pa.array(text, pa.string()), pa.array(language != UNKNOWN, pa.bool_())], names)

    out = wide.mapInArrow(run, "id bigint, host string, suffix string, declared string, n_trigrams bigint, language string, probability double, text_language string, accepted boolean")
    return out.select(F.col("id").alias(key), "language", "probability", "text_language", "accepted", "n_trigrams", "host", "suffix", "declared")


def _declared(col: str) -> Column:
    """The primary subtag of the lang attribute of an html element, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(col, r"(?i)<html\s(?:[^>]*\s)?lang=[\"']?([a-zA-Z]{2,3})\b", 1)), F.lit(""))


def documents(spark: SparkSession, docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Languages of ``documents``: the source is the host, its last part after a dot the suffix, a lang attribute in the text the declaration; the lang column labels the fit."""
    languages, model = fit(docs, key="doc_id", text="text", label="lang", sample=sample)
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("host"), F.nullif(F.regexp_extract("source", r"\.([a-zA-Z]{2,})$", 1), F.lit("")).alias("suffix"), _declared("text").alias("declared"))
    return identify(spark, rows, languages, model, key="doc_id")


def pages(spark: SparkSession, web: DataFrame, docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Languages of all visible text of ``pages``, character references decoded, with the models fitted on labelled ``docs``."""
    languages, model = fit(docs, key="doc_id", text="text", label="lang", sample=sample)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    rows = web.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")).alias("suffix"), _declared("html").alias("declared"))
    return identify(spark, rows, languages, model, key="page_id", read=visible_text)
