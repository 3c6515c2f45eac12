"""Redaction of sensitive text in every public field, with counts.

Texts go through a chain of native pattern replacements, custom patterns first, each seeing what the ones before left.
JSON contents and metadata are walked by an Arrow function (keys and values; keys that collide get a numbered suffix).
Java's word classes are ASCII unless told otherwise, so patterns run in its Unicode mode.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaypack.functions.patterns import DEFAULT_DETECTORS, DETECTOR_NAME, DETECTORS, MAX_CUSTOM, REDACTED
from relaypack.operators.frames import Frames, Policy

UNICODE = "(?U)"


def pattern_chain(detectors: Iterable[str] = DEFAULT_DETECTORS, custom: dict[str, str] | None = None, max_pattern_bytes: int = 1000) -> list[tuple[str, str]]:
    """(name, pattern) in the order in which they run; a detector of a custom pattern's name takes over its place."""
    custom = dict(custom or {})
    if len(custom) > MAX_CUSTOM:
        raise ValueError(f"more than {MAX_CUSTOM} custom patterns")
    chain = dict(custom)
    for name in detectors:
        if name not in DETECTORS:
            raise ValueError(f"unknown detector {name!r}")
        chain[name] = DETECTORS[name]
    for name, p in chain.items():
        if not re.fullmatch(DETECTOR_NAME, name):
            raise ValueError(f"bad detector name {name!r}")
        if len(p.encode()) > max_pattern_bytes:
            raise ValueError(f"pattern {name!r} is too long")
        if not p or re.compile(p).match(""):
            raise ValueError(f"pattern {name!r} matches an empty text")
    return list(chain.items())


def redact_text(col: Column, chain: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(redacted text, number of replacements)."""
    count: Column = F.lit(0).cast("long")
    for name, p in chain:
        p = UNICODE + p
        count = count + F.coalesce(F.regexp_count(col, F.lit(p)), F.lit(0)).cast("long")
        col = F.regexp_replace(col, p, re.sub(r"([\\$])", r"\\\1", REDACTED.format(name)))
    return col, count


def _redact_tags(tags: Column, chain: list[tuple[str, str]]) -> tuple[Column, Column]:
    new = F.array_sort(F.array_distinct(F.transform(tags, lambda t: redact_text(t, chain)[0])))
    return new, F.aggregate(tags, F.lit(0).cast("long"), lambda a, t: a + redact_text(t, chain)[1])


def redact_value(value, patterns, timeout: float):
    """(value, replacements) of parsed JSON, keys included."""
    if isinstance(value, str):
        n = 0
        for mark, p in patterns:
            value, k = p.subn(mark, value, timeout=timeout)
            n += k
        return value, n
    if isinstance(value, list):
        pairs = [redact_value(x, patterns, timeout) for x in value]
        return [x for x, _ in pairs], sum(n for _, n in pairs)
    if isinstance(value, dict):
        out, total = {}, 0
        for k, v in value.items():
            name, a = redact_value(k, patterns, timeout)
            v, b = redact_value(v, patterns, timeout)
            free, i = name, 1
            while free in out:
                i += 1
                free = f"{name}__{i}"
            out[free] = v
            total += a + b
        return out, total
    return value, 0


def json_redactor(chain: list[tuple[str, str]], timeout_ms: int = 50):
    """Arrow function: JSON text -> (text, replacements, failed). A pattern that takes too long fails the row."""

    @F.pandas_udf("text string, n bigint, failed boolean")
    def run(col: pd.Series) -> pd.DataFrame:
        import regex

        patterns = [(REDACTED.format(n), regex.compile(p)) for n, p in chain]
        rows = []
        for x in col:
            if x is None or x in ("{}", "[]"):
                rows.append((x, 0, False))
                continue
            try:
                v, n = redact_value(json.loads(x), patterns, timeout_ms / 1000)
                rows.append((json.dumps(v, ensure_ascii=False, separators=(",", ":")) if n else x, n, False))
            except (TimeoutError, ValueError):
                rows.append((x, 0, True))
        return pd.DataFrame(rows, columns=["text", "n", "failed"])

    return run


def _apply(df: DataFrame, texts: list[str], jsons: list[str], chain: list[tuple[str, str]], nested: bool, timeout_ms: int) -> DataFrame:
    """Redact columns; adds n_redacted and failed. The content column is a text or JSON by content_type."""
    count: Column = F.lit(0).cast("long")
    failed: Column = F.lit(False)
    new: dict[str, Column] = {}
    for c in texts:
        new[c], k = redact_text(F.col(c), chain)
        count = count + k
    if "tags" in df.columns:
        new["tags"], k = _redact_tags(F.col("tags"), chain)
        count = count + k
    if "content" in df.columns:
        text, k = redact_text(F.col("content"), chain)
        plain = F.col("content_type") == "text"
        new["content"] = F.when(plain, text).otherwise(F.col("content"))
        count = count + F.when(plain, k).otherwise(0)
    if nested:
        run = json_redactor(chain, timeout_ms)
        if "content" in df.columns:
            df = df.withColumn("_c", run(F.when(F.col("content_type") != "text", F.col("content"))))
            new["content"] = F.when(F.col("content_type") == "text", new["content"]).otherwise(F.col("_c.text"))
            count, failed = count + F.coalesce(F.col("_c.n"), F.lit(0)), failed | F.coalesce(F.col("_c.failed"), F.lit(False))
        for c in jsons:
            df = df.withColumn("_" + c, run(F.col(c)))
            new[c] = F.col(f"_{c}.text")
            count, failed = count + F.coalesce(F.col(f"_{c}.n"), F.lit(0)), failed | F.coalesce(F.col(f"_{c}.failed"), F.lit(False))
    return df.withColumns({"n_redacted": count, "failed": failed, **new}).drop("_c", *("_" + c for c in jsons))


def scan_size(f: Frames) -> DataFrame:
    """handoff_id, bytes and number of texts that redaction scans."""
    m = f.messages.select("handoff_id", (F.octet_length("role") + F.octet_length("kind") + F.octet_length("content") + F.octet_length("metadata_json") + F.aggregate("tags", F.lit(0), lambda a, t: a + F.octet_length(t))).alias("b"), (F.lit(3) + F.size("tags")).alias("n"))
    a = f.artifacts.select("handoff_id", (F.octet_length("name") + F.octet_length("media_type") + F.octet_length("content") + F.octet_length("metadata_json")).alias("b"), F.lit(3).alias("n"))
    h = f.handoffs.select("handoff_id", (F.octet_length("sender") + F.octet_length("receiver") + F.octet_length("metadata_json")).alias("b"), F.lit(2).alias("n"))
    return m.unionAll(a).unionAll(h).groupBy("handoff_id").agg(F.sum("b").alias("bytes"), F.sum("n").alias("texts"))


def redact(detectors: Iterable[str] = DEFAULT_DETECTORS, custom: dict[str, str] | None = None, *, stage: str = "input", max_pattern_bytes: int = 1000, max_scan_bytes: int = 1_000_000, max_scan_strings: int = 10_000, timeout_ms: int = 50, keep_source: bool = False) -> Policy:
    """Policy: redact every public field of each handoff. ``keep_source`` keeps a digest of the text before it, for a later dedup."""
    chain = pattern_chain(detectors, custom, max_pattern_bytes)
    if not 0 < timeout_ms <= 1000 or stage not in ("input", "egress"):
        raise ValueError("bad redaction setting")
    name = "redact" if stage == "input" else "egress_redact"

    def run(f: Frames) -> Frames:
        big = scan_size(f).where((F.col("bytes") > max_scan_bytes) | (F.col("texts") > max_scan_strings))
        f = f.deny(name, "redaction", big)
        m = f.messages
        if keep_source:
            m = m.withColumn("src_key", source_key())
        m = _apply(m, ["role", "kind"], ["metadata_json"], chain, f.nested, timeout_ms)
        a = _apply(f.artifacts, ["name", "media_type"], ["metadata_json"], chain, f.nested, timeout_ms)
        h = _apply(f.handoffs, ["sender", "receiver"], ["metadata_json"], chain, f.nested, timeout_ms)
        each = m.select("handoff_id", "n_redacted").unionAll(a.select("handoff_id", "n_redacted")).unionAll(h.join(f.denials, "handoff_id", "left_anti").select("handoff_id", "n_redacted"))
        counts = each.groupBy("handoff_id").agg(F.sum("n_redacted").alias("count"))
        out = f.with_(messages=m.drop("n_redacted", "failed"), artifacts=a.drop("n_redacted", "failed"), handoffs=h.drop("n_redacted", "failed")).event(name, "redacted", counts)
        if f.nested:
            bad = m.where("failed").select("handoff_id").union(a.where("failed").select("handoff_id")).union(h.where("failed").select("handoff_id"))
            out = out.deny(name, "redaction", bad)
        return out

    run.rank, run.name = (20 if stage == "input" else 45), name
    return run


def source_key() -> Column:
    """Digest of a message's public fields."""
    return F.sha2(F.to_json(F.struct("role", "content_type", "content", "kind", F.array_sort("tags").alias("tags"), "metadata_json")), 256)
