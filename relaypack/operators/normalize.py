"""Rule-based normalization: messages of several sections are split, the others are given one.

Objects are split natively. Texts that may hold two headings or more are split by an Arrow function, since code fences
make the meaning of a line depend on the lines before it; all others never leave the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions.arrow import arrow_function
from relaypack.functions import classify as cl
from relaypack.functions.patterns import HINT_KEYS, LINE_END, TEXT_LABELS
from relaypack.operators.frames import Frames
from relaypack.operators.shared import cut
from relaypack.operators.state import explicit_sections
from relaypack.schema import SECTIONS

PART = "struct<section:string,content_type:string,content:string>"
_END = re.compile(LINE_END)
_FENCE = re.compile(r"^(`{3,}|~{3,})(.*)$", re.S)
_MARK = re.compile(r"^(?:[-*][ \t]+)?(?:#{1,6}[ \t]+)?")
_LABEL = re.compile(rf"({cl.labels_pattern()})\s*[:：]\s*(.*)$", re.I | re.S)
_BOLD = re.compile(rf"\*\*\s*({cl.labels_pattern()})\s*([:：]?)\s*\*\*(.*)$", re.I | re.S)


def line_heading(line: str) -> tuple[str, str] | None:
    t = _MARK.sub("", line.strip())
    if m := _BOLD.match(t):
        t = m[1] + (":" if m[2] else "") + m[3]
    m = _LABEL.match(t)
    return (TEXT_LABELS[m[1].lower()], m[2].strip()) if m else None


def split_lines(text: str) -> list[str]:
    """Lines with their ends."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return out + ([text[at:]] if at < len(text) else [])


def split_text(text: str) -> list[tuple[str | None, str]] | None:
    """(section, content) of each part; null if it isn't of several parts. A fence hides the headings inside it."""
    parts: list[list] = []  # section, raw heading line, lines
    fence = ""
    for raw in split_lines(text):
        bare = _END.sub("", raw)
        m = _FENCE.match(bare.strip())
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m:
            fence = m[1]
        elif found := line_heading(bare):
            parts.append([found[0], bare, [found[1]]])
            continue
        if not parts:
            parts.append([None, "", []])
        parts[-1][2].append(bare)
    out = []
    for section, head, rows in parts:
        body = "\n".join(rows).strip()
        if section is not None and not body:
            out.append((None, head.strip()))
        elif body:
            out.append((section, body))
    return out if len(out) > 1 and any(s for s, _ in out) else None


@arrow_function(f"array<{PART}>")
def split_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: (p := split_text(t)) and [{"section": s, "content_type": "text", "content": c} for s, c in p] if t is not None else None)


def split_object() -> Column:
    """Parts of an object whose keys name two sections or more: a part a key in key order, then the rest."""
    keys = F.json_object_keys("content")
    # values as JSON text, in the order of the keys
    held = F.from_json("content", "map<string,variant>")
    text = F.from_json("content", "map<string,string>")
    named = F.filter(keys, lambda k: cl.key_section(k).isNotNull())
    value = lambda k: F.element_at(held, k)
    is_text = lambda k: F.schema_of_variant(value(k)) == "STRING"
    is_box = lambda k: F.schema_of_variant(value(k)).rlike("^(ARRAY|OBJECT)")
    one = F.transform(named, lambda k: F.struct(
        cl.key_section(k).alias("section"),
        F.when(is_text(k), "text").when(F.schema_of_variant(value(k)).startswith("ARRAY"), "array").otherwise("object").alias("content_type"),
        F.when(is_text(k) | is_box(k), F.element_at(text, k)).otherwise(F.concat(F.lit("{"), F.to_json(F.create_map(k, value(k))).substr(F.lit(2), F.lit(1 << 30)))).alias("content"),
    ))
    rest = F.map_filter(held, lambda k, _: cl.key_section(k).isNull())
    tail = F.when(F.size(rest) > 0, F.array(F.struct(F.lit(None).cast("string").alias("section"), F.lit("object").alias("content_type"), F.to_json(rest).alias("content")))).otherwise(F.array().cast(f"array<{PART}>"))
    return F.concat(one.cast(f"array<{PART}>"), tail)


def normalize(messages: DataFrame, *, nested: bool = False) -> DataFrame:
    """Messages with ``section``, ``kind`` set to it, and source_idx, part, rule, conflict.

    ``rule`` is null for unclassified parts; ``conflict`` marks rows that deny their handoff.
    """
    explicit = explicit_sections()
    keys = F.coalesce(F.json_object_keys("metadata_json"), F.array().cast("array<string>"))
    overridden = (F.size(explicit) > 0) | F.arrays_overlap(keys, F.array(*map(F.lit, HINT_KEYS))) | cl.is_tool()
    is_object, is_text = F.col("content_type") == "object", F.col("content_type") == "text"
    none = F.lit(None).cast(f"array<{PART}>")
    m = messages.withColumn("_free", ~overridden)
    m = m.withColumn("_texts", split_texts(F.when(F.col("_free") & is_text & F.col("content").rlike(LINE_END) & cl.maybe_heading_lines(F.col("content")), F.col("content"))))
    parts = F.col("_texts")
    if nested:
        parts = F.when(F.col("_free") & is_object & (F.size(cl.structured_sections(F.col("content"))) >= 2), split_object()).otherwise(parts)
    m = m.withColumn("_parts", F.coalesce(parts, none))
    m = m.select("*", F.posexplode_outer("_parts").alias("part", "_p"))
    split = F.col("_p").isNotNull()
    m = m.withColumns({
        "source_idx": F.col("msg_idx"), "part": F.coalesce("part", F.lit(0)), "_split": split, "_how": F.when(split & (F.col("content_type") == "text"), "text_split").when(split, "structured_split"),
        "content_type": F.coalesce("_p.content_type", "content_type"), "content": F.coalesce("_p.content", "content"), "_section": F.col("_p.section"),
    })
    m = m.withColumn("_label", cl.text_label(F.when(F.col("content_type") == "text", F.col("content"))))
    raw_hint = F.lower(cl.hint(F.col("metadata_json")))
    hinted = F.coalesce(cl.key_section(raw_hint), F.when(F.regexp_replace(raw_hint, "[^a-z0-9]+", "_").isin(*[s for s in SECTIONS if s != "artifacts"]), F.regexp_replace(raw_hint, "[^a-z0-9]+", "_")))
    objects = F.when(F.col("content_type") == "object", cl.structured_sections(F.col("content")))
    m = m.withColumns({"_head": F.col("_label.section"), "_body": F.col("_label.body"), "_hint": hinted, "_obj": F.when(F.size(objects) == 1, F.get(objects, 0))})
    signals = F.filter(F.array(
        F.struct(F.col("_hint").alias("s"), F.lit("metadata_hint").alias("r")), F.struct(F.when(cl.is_tool(), F.lit("tool_results")).alias("s"), F.lit("tool_role_or_kind").alias("r")),
        F.struct(F.col("_obj").alias("s"), F.lit("structured_key").alias("r")), F.struct(F.col("_head").alias("s"), F.lit("text_prefix").alias("r")),
    ), lambda x: x["s"].isNotNull())
    m = m.withColumn("_sig", signals)
    places = F.array_distinct(F.transform("_sig", lambda x: x["s"]))
    exp = explicit_sections()
    m = m.withColumns({
        "conflict": F.when(F.col("_split"), False).otherwise((F.size(exp) > 1) | F.array_contains(exp, "artifacts") | (raw_hint == "artifacts") | ((F.size(exp) == 0) & (F.size(places) > 1))),
        "section": F.when(F.col("_split"), F.col("_section")).when(F.size(exp) == 1, F.get(exp, 0)).when(F.size(places) == 1, F.get(places, 0)),
        "rule": F.when(F.col("_split") & F.col("_section").isNotNull(), F.col("_how")).when(F.col("_split"), None).when(F.size(exp) == 1, "explicit_kind_or_tag").when(F.size(places) == 1, F.array_join(F.array_sort(F.array_distinct(F.transform("_sig", lambda x: x["r"]))), "+")),
    })
    by_text = ~F.col("_split") & (F.size(exp) == 0) & F.col("_head").isNotNull() & F.col("section").isNotNull()
    m = m.withColumns({"content": F.when(by_text, F.col("_body")).otherwise(F.col("content")), "kind": F.when((F.size(exp) == 0) | F.col("_split"), F.coalesce("section", "kind")).otherwise(F.col("kind")), "conflict": F.coalesce("conflict", F.lit(False))})
    return m.drop("_free", "_texts", "_parts", "_p", "_split", "_how", "_section", "_label", "_head", "_body", "_hint", "_obj", "_sig")


def report(normalized: DataFrame) -> DataFrame:
    """handoff_id, classified, normalized, unclassified (counts of source messages), unclassified_indices, rule_counts."""
    per = normalized.groupBy("handoff_id", "source_idx").agg(F.bool_or(F.col("rule").isNotNull()).alias("c"), F.bool_or(F.col("rule").isNotNull() & (F.col("rule") != "explicit_kind_or_tag")).alias("n"), F.bool_or(F.col("rule").isNull()).alias("u"))
    one = per.groupBy("handoff_id").agg(F.count_if("c").alias("classified"), F.count_if("n").alias("normalized"), F.count_if("u").alias("unclassified"), F.array_sort(F.collect_list(F.when(F.col("u"), F.col("source_idx")))).alias("unclassified_indices"))
    rules = normalized.where("rule is not null").groupBy("handoff_id", "rule").agg(F.count(F.lit(1)).alias("k")).groupBy("handoff_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "k")))).alias("rule_counts"))
    return one.join(rules, "handoff_id", "left")


def normalize_frames(f: Frames) -> tuple[Frames, DataFrame]:
    """Frames with split and classified messages, numbered anew, and the report. The messages are written once: all that follows reads them several times."""
    n = normalize(f.messages, nested=f.nested)
    n = cut(n.withColumn("msg_idx", (F.row_number().over(Window.partitionBy("handoff_id").orderBy("source_idx", "part")) - 1).cast("int")), "normalized")
    f = f.deny("history_normalizer", "contract", n.where("conflict"))
    told = report(n)
    rows = n.drop("part", "rule", "conflict", "source_idx").join(f.denials.select("handoff_id"), "handoff_id", "left_anti")
    return f.with_(messages=rows).event("history_normalizer", "classified", told.select("handoff_id", F.col("classified").alias("count"))), told
