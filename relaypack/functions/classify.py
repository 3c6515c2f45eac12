"""Which section a message belongs to: headings, structured keys, hints and tool rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaypack.functions.patterns import HINT_KEYS, KEY_SECTIONS, LINE_END, TEXT_LABELS, TOOL_KINDS
from relaypack.functions.text import let, normal_key, strip

_LABELS = "|".join(re.escape(x).replace("\\ ", " ") for x in sorted(TEXT_LABELS, key=lambda x: (-len(x), x)))
_MARKS = r"^(?:[-*][ \t]+)?(?:#{1,6}[ \t]+)?"
_PLAIN = rf"(?isU)^({_LABELS})\s*[:：]\s*(.*)$"
_LABELLED = rf"(?isU)^({_LABELS})\s*[:：]"
_BOLD = rf"(?isU)^\*\*\s*({_LABELS})\s*[:：]?\s*\*\*(.*)$"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


def heading(text: Column) -> Column:
    """struct(section, body) of a text that begins with a label and a colon, else of nulls.

    A list or heading mark before and a balanced bold mark around the label are allowed.
    """

    def flat(t: Column) -> Column:
        # a bold label, with or without its colon, is read as the plain one
        rest = F.regexp_extract(t, _BOLD, 2)
        colon = F.when(t.rlike(rf"(?isU)^\*\*\s*(?:{_LABELS})\s*[:：]\s*\*\*"), ":").otherwise("")
        return F.when(t.startswith("**") & t.rlike(_BOLD), F.concat(F.regexp_extract(t, _BOLD, 1), colon, rest)).otherwise(t)

    def read(t: Column) -> Column:
        section = F.try_element_at(_map(TEXT_LABELS), F.lower(F.regexp_extract(t, _LABELLED, 1)))
        return let(section, lambda s: F.struct(s.alias("section"), F.when(s.isNotNull(), strip(F.regexp_extract(t, _PLAIN, 2))).alias("body")))

    return let(F.regexp_replace(strip(text), _MARKS, ""), lambda t: let(flat(t), read))


def text_label(text: Column) -> Column:
    """As heading(), but a label without a body is none. Take its fields from a column that holds it, so that it is computed once."""
    full = lambda h: F.length(h["body"]) > 0
    return let(heading(text), lambda h: F.struct(F.when(full(h), h["section"]).alias("section"), F.when(full(h), h["body"]).alias("body")))


def text_section(text: Column) -> tuple[Column, Column]:
    """The fields of text_label(), each computed by itself."""
    label = text_label(text)
    return label["section"], label["body"]


def key_section(key: Column) -> Column:
    return F.try_element_at(_map(KEY_SECTIONS), normal_key(key))


def structured_sections(content: Column) -> Column:
    """Distinct sections that the keys of a JSON object name."""
    return F.array_compact(F.array_distinct(F.transform(F.json_object_keys(content), key_section)))


def hint(metadata_json: Column) -> Column:
    """The raw value of the first hint key."""
    return F.coalesce(*(F.get_json_object(metadata_json, f"$.{k}") for k in HINT_KEYS))


def is_tool() -> Column:
    return (F.col("role") == "tool") | F.col("kind").isin(*TOOL_KINDS)


def maybe_heading_lines(text: Column) -> Column:
    """Whether a line of a text may open a section; those without need no splitting."""
    return text.rlike(rf"(?imU)(?:^|{LINE_END})[ \t]*(?:[-*][ \t]+)?(?:#{{1,6}}[ \t]+)?(?:\*\*\s*)?(?:{_LABELS})\s*(?:\*\*\s*)?[:：*]")


def labels_pattern() -> str:
    return _LABELS
