"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line of a text, or adjacent lines that hold a wrapped notice together (``spans``). Its features are the distinct word n-grams (one to three words) that hold an anchor, a word that begins with a
licence stem or is a licence's short name; multinomial logistic regression over these sparse features gives each licence family and an
unknown class a probability, calibrated by a temperature fitted on held-out paragraphs. A prediction counts if its
probability reaches ``LEAST`` and the paragraph covers ``COVER`` of the n-grams of one of the family's templates.

The model is fitted on the driver from the sentences of ``license_texts``, their variations and counter-examples: a fixed, bounded
set of 34 families, with notices of made-up licences as unknown. Its weights (some thousand rows) and the templates' n-grams are broadcast. A line without a stem has no feature,
so leaving it out early changes nothing. Texts are never moved: only lines with features are exploded, and sums are
partial before they are shuffled by document and line.

A row without an id has no finding. A null or empty text has no paragraph and no licence. Repeated rows (equal doc_id) share their findings, since lines are summed by document and
place. Ties between families go to the first by name. Extra columns don't matter.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.llm.common import materialize
from relaypack.llm.license_texts import NEGATIVES, TEMPLATES

UNKNOWN = "unknown"
LEAST, COVER = 0.6, 0.5
#: An anchor has a part (between hyphens, stops and plus signs) that begins with one of these, or is one of the words.
STEMS = ("licen", "copyright", "copyleft", "apache", "mozilla", "creative", "commons", "redistribut", "warrant", "permission", "permitted", "reserved", "spdx", "proprietary", "confidential", "unlicen", "eclipse", "boost", "artistic", "postgresql", "affero", "cecill", "wtfpl", "agreement", "unencumbered", "illinois")
WORDS = ("public", "gnu", "gpl", "lgpl", "agpl", "gplv2", "gplv3", "lgplv3", "agplv3", "mpl", "epl", "eupl", "bsd", "mit", "isc", "cc", "cc0", "cddl", "sspl", "zlib", "ofl", "psf", "by-nc", "by-sa", "by-nd", "by-nc-sa", "domain")
TOKEN = "[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?"

#: Words after its first line up to which a wrapped notice is read: twice those of the longest template.
REACH = 2 * max(len(re.findall(TOKEN, t.lower())) for ts in TEMPLATES.values() for t in ts)
_FILL = "the a of and to in it was for on with as at by from this that new data project file text page work example team year version".split()


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


@lru_cache(maxsize=1 << 16)
def is_anchor(word: str) -> bool:
    parts = re.split("[.+-]+", word)
    return word in WORDS or any(p in WORDS or p.startswith(STEMS) for p in parts)


def grams(text: str) -> set[str]:
    """The features of a paragraph: its n-grams of one to three words that hold an anchor."""
    t = tokens(text)
    out = set()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            part = t[i : i + n]
            if any(map(is_anchor, part)):
                out.add(" ".join(part))
    return out


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # by name, unknown last
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    temperature: float
    held_out: float  # accuracy on held-out variations


def _vary(r: random.Random, text: str) -> str:
    words = text.split()
    for _ in range(r.randint(0, 2)):
        if len(words) > 4:
            del words[r.randrange(len(words))]
    words = [re.sub(r"\d", lambda m: str(r.randint(1, 4)), w) if r.random() < 0.2 else w for w in words]
    fill = lambda: r.choices(_FILL, k=r.randint(0, 6))
    return " ".join(fill() + words + fill())


def anchor_words(m: Model) -> list[str]:
    """All words with a stem that a feature of the model or a template holds."""
    known = {w for g in m.weights for w in g.split()} | {w for ts in TEMPLATES.values() for t in ts for w in tokens(t)}
    return sorted(filter(is_anchor, known))


@lru_cache(maxsize=1)
def fit(seed: int = 5, each: int = 60) -> Model:
    """Multinomial logistic regression by gradient descent; temperature by held-out likelihood."""
    r = random.Random(seed)
    families = (*sorted(TEMPLATES), UNKNOWN)
    data: list[tuple[set[str], int]] = []
    for i, f in enumerate(families[:-1]):
        for t in TEMPLATES[f]:
            own = grams(t)
            varied = [g for g in (grams(_vary(r, t)) for _ in range(each)) if len(g & own) >= COVER * len(own)]  # less could not be confirmed
            data += [(own, i)] + [(g, i) for g in varied]
    data += [(grams(_vary(r, t)), len(families) - 1) for t in NEGATIVES for _ in range(each)]
    data += [(grams(" ".join(r.choices(_FILL + [w for t in NEGATIVES for w in t.split()], k=12))), len(families) - 1) for _ in range(20 * each)]
    r.shuffle(data)
    count: dict[str, int] = {}
    for g, _ in data:
        for x in g:
            count[x] = count.get(x, 0) + 1
    names = sorted(x for x, n in count.items() if n >= 12)
    at = {x: i for i, x in enumerate(names)}
    x, y = np.zeros((len(data), len(names)), np.float32), np.array([c for _, c in data])
    for i, (g, _) in enumerate(data):
        x[i, [at[z] for z in g if z in at]] = 1
    cut = len(data) * 4 // 5
    xt, yt, xh, yh = x[:cut], np.eye(len(families), dtype=np.float32)[y[:cut]], x[cut:], y[cut:]
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)
    b[-1] = 2.0
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(600):
        z = xt @ w + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p = (p / p.sum(1, keepdims=True) - yt) / cut
        vw, vb = 0.9 * vw - 1.0 * (xt.T @ p + 2e-5 * w), 0.9 * vb - 0.2 * p.sum(0)
        w, b = w + vw, b + vb
    z = xh @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(-(q[np.arange(len(yh)), yh] - np.log(np.exp(q).sum(1))).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=loss)
    weights = {n: tuple(round(float(v), 4) for v in w[i]) for n, i in at.items()}
    return Model(families, tuple(round(float(v), 4) for v in b), weights, temperature, float((z.argmax(1) == yh).mean()))


def _stem(col: Column) -> Column:
    """Whether a lower-cased text may hold an anchor."""
    out = col.contains(STEMS[0])
    for s in STEMS[1:]:
        out = out | col.contains(s)
    return out | col.rlike(r"(?<![a-z0-9])(?:" + "|".join(WORDS) + ")(?![a-z0-9])")


def _ngrams(t: Column, places: Column) -> Column:
    """Distinct n-grams that hold an anchor, of an array of tokens and the places (from 1) of its anchors."""

    def run(start: Column, n: int) -> Column:
        return F.when((start >= 1) & (start + (n - 1) <= F.size(t)), F.array_join(F.slice(t, F.greatest(start, F.lit(1)), F.lit(n)), " "))

    near = F.transform(places, lambda p: F.array(*(run(p - back, n) for n in (1, 2, 3) for back in range(n))))
    return F.array_compact(F.array_distinct(F.flatten(near)))


def paragraphs(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, place, family, probability, cover, confirmed for each line with a feature."""
    m = model or fit()
    text = F.lower("text")
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & _stem(text)).select("doc_id", F.posexplode(F.split(text, "\r?\n")).alias("place", "line")).where(_stem(F.col("line")))
    anchors = F.array(*(F.lit(w) for w in anchor_words(m)))
    worded = lines.select("doc_id", "place", F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)).alias("t")).where(F.arrays_overlap("t", anchors))
    placed = worded.select("doc_id", "place", "t", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.array_contains(anchors, F.element_at("t", i))).alias("at"))
    found = materialize(spark, placed.select("doc_id", "place", F.explode(_ngrams(F.col("t"), F.col("at"))).alias("gram")).distinct(), "grams")
    return _judged(spark, found, ["doc_id", "place"], m)[0].drop("hits")


def _judged(spark: SparkSession, found: DataFrame, keys: list[str], m: Model) -> tuple[DataFrame, DataFrame]:
    """keys, family, probability, cover, hits, confirmed of what the model is sure of; and keys, family, cover, hits of all that shares n-grams with a template."""
    k = len(m.families)
    weights = F.broadcast(spark.createDataFrame([(g, *w) for g, w in m.weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(k))))
    scored = found.join(weights, "gram").groupBy(*keys).agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in range(k)))
    z = F.array(*((F.col(f"s{i}") + m.bias[i]) / m.temperature for i in range(k)))
    scored = scored.select(*keys, z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = F.element_at(F.array(*map(F.lit, m.families)), F.array_position("z", F.col("top")).cast("int"))  # the first of equal ones
    scored = scored.select(*keys, best.alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST))
    sets = [(f, f"{f}/{i}", g, len(grams(t))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in sorted(grams(t))]
    template = F.broadcast(spark.createDataFrame(sets, "family string, template string, gram string, size int"))
    by_template = found.join(template, "gram").groupBy(*keys, "family", "template").agg(F.count_distinct("gram").alias("n"), F.first("size").alias("of"))
    covers = by_template.groupBy(*keys, "family").agg(F.max(F.struct((F.col("n") / F.col("of")).alias("cover"), "n")).alias("b"))
    covers = materialize(spark, covers.select(*keys, "family", "b.cover", F.col("b.n").alias("hits")), "covers")
    out = scored.join(covers, [*keys, "family"], "left").withColumns({"cover": F.coalesce("cover", F.lit(0.0)), "hits": F.coalesce("hits", F.lit(0))})
    return out.withColumn("confirmed", F.col("cover") >= COVER), covers


def spans(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, place, end, family, probability, cover, confirmed for lines, and for adjacent lines that hold a wrapped notice together.

    Adjacent lines are read as one, joined by a space, up to ``REACH`` words between the first and the last; a line
    without words ends them. They count if they are confirmed and cover more of a template of their family than
    without their first or last line. What lies within such lines and has fewer n-grams of its template is left to them.
    """
    m = model or fit()
    anchors = F.array(*(F.lit(w) for w in anchor_words(m)))
    text = F.lower("text")
    worded = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & _stem(text)).select("doc_id", F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))).alias("ls"))
    worded = worded.select("doc_id", "ls", F.transform("ls", lambda t: F.size(t)).alias("ns"), F.transform("ls", lambda t: F.arrays_overlap(t, anchors)).alias("has")).where(F.exists("has", lambda x: x))
    state = lambda words, n, more: F.struct(words.cast("int").alias("words"), n.cast("int").alias("n"), more.alias("more"))

    def following(i: Column) -> Column:
        """How many lines after line i (from 1) may be read with it."""

        def step(acc: Column, n: Column) -> Column:
            go = acc["more"] & (n > 0)
            return state(acc["words"] + n, acc["n"] + go.cast("int"), go & (acc["words"] + n < REACH))

        return F.aggregate(F.slice("ns", i + 1, F.lit(REACH)), state(F.lit(0), F.lit(0), F.lit(True)), step, lambda acc: acc["n"])

    def windows(i: Column) -> Column:
        ends = F.filter(F.sequence(i, i + following(i)), lambda j: F.exists(F.slice("has", i, j - i + 1), lambda x: x))
        return F.transform(ends, lambda j: F.struct((i - 1).alias("place"), (j - 1).alias("end"), F.flatten(F.slice("ls", i, j - i + 1)).alias("t")))

    near = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: (F.element_at("ns", i) > 0) & F.exists(F.slice("has", i, F.lit(REACH + 1)), lambda x: x))
    read = worded.select("doc_id", F.explode(F.flatten(F.transform(near, windows))).alias("v")).select("doc_id", "v.place", "v.end", "v.t")
    placed = read.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.array_contains(anchors, F.element_at("t", i))))
    keys = ["doc_id", "place", "end"]
    found = materialize(spark, placed.select(*keys, F.explode(_ngrams(F.col("t"), F.col("at"))).alias("gram")).distinct(), "grams")
    judged, covers = _judged(spark, found, keys, m)
    judged = materialize(spark, judged, "judged")
    less = covers.select("doc_id", "place", "end", "family", F.col("cover").alias("part"))
    shorter = less.withColumn("place", F.col("place") - 1).unionAll(less.withColumn("end", F.col("end") + 1)).groupBy(*keys, "family").agg(F.max("part").alias("part"))
    wrapped = judged.where("confirmed and end > place").join(shorter, [*keys, "family"], "left").where(F.col("cover") > F.coalesce("part", F.lit(0.0))).drop("part")
    wrapped = materialize(spark, wrapped, "wrapped")
    over = wrapped.select("doc_id", F.explode(F.sequence("place", "end")).alias("place"), F.col("end").alias("last"), F.col("hits").alias("more"))
    every = judged.where("end = place").unionByName(wrapped)
    return every.join(over.withColumnsRenamed({"doc_id": "id", "place": "line_"}), (F.col("doc_id") == F.col("id")) & (F.col("place") == F.col("line_")) & (F.col("end") <= F.col("last")) & (F.col("hits") < F.col("more")), "left_anti").drop("hits")


def scan(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, families (confirmed, by name, joined by commas; null if none), license, probability, n_unconfirmed."""
    p = spans(spark, docs, model)
    ok = F.col("confirmed")
    by_doc = p.groupBy(F.col("doc_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("family")))), ",").alias("families"),  # no more than there are families
        F.max(F.when(ok, F.struct("probability", "family"))).alias("top"), F.count_if(~ok).alias("n_unconfirmed"),
    )
    n = F.when(F.length("text") > 0, F.size(F.filter(F.split("text", "\r?\n"), lambda x: F.length(F.trim(x)) > 0))).otherwise(0)
    base = docs.select("doc_id", n.alias("n_paragraphs"))
    return base.join(by_doc, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_paragraphs", F.nullif("families", F.lit("")).alias("families"), F.coalesce(F.col("top.family"), F.lit(UNKNOWN)).alias("license"), F.round(F.col("top.probability"), 6).alias("probability"), F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"))
