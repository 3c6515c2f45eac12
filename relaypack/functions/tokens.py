"""Canonical bytes and token counts, as integer expressions.

Two serializations define sizes: the *wide* form of messages and envelopes (sorted keys, ", " and ": "), used by the
policy budget, and the *compact* form of packets (sorted keys, no spaces, default fields left out). Contents and
metadata are stored as compact JSON text, so both sizes come from it without parsing: the wide form has one byte more
for each comma and colon outside of strings. Key order doesn't change a size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the fixed parts.
WIDE_MESSAGE, WIDE_ARTIFACT, WIDE_ENVELOPE, COMPACT_PACKET = 57, 53, 73, 169


def literal(col: Column) -> Column:
    """The JSON literal of a string, with UTF-8 kept. Control characters are written with lower-case digits."""
    raw = F.to_json(F.struct(col.alias("t")))
    lit = F.substring(raw, F.lit(6), F.length(raw) - 6)
    odd = col.rlike("[\u000b\u000e\u000f\u001a-\u001f]")
    low = lit
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        low = F.regexp_replace(low, r"(?<!\\)((?:\\\\)*)\\u00" + code, r"$1\\u00" + code.lower())
    return F.when(odd, low).otherwise(lit)


def literal_bytes(col: Column) -> Column:
    """Bytes of the JSON literal of a string."""
    return (F.octet_length(F.to_json(F.struct(col.alias("t")))) - 6).cast("long")


def wide_extra(json_text: Column) -> Column:
    """Commas and colons outside of strings, in compact JSON."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(json_text, r'"(?:[^"\\]|\\.)*"', ""), "[^,:]", "")), F.lit(0)).cast("long")


def json_bytes(json_text: Column, *, wide: bool) -> Column:
    size = F.octet_length(json_text).cast("long")
    return size + wide_extra(json_text) if wide else size


def content_bytes(kind: Column, content: Column, *, wide: bool) -> Column:
    return F.when(kind == "text", literal_bytes(content)).otherwise(json_bytes(content, wide=wide))


def tags_bytes(tags: Column, *, wide: bool) -> Column:
    gap = 2 if wide else 1
    total = F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, t: a + literal_bytes(t) + gap)
    return F.lit(2) + F.when(total > 0, total - gap).otherwise(0)


def message_bytes(*, wide: bool, prefix: str = "") -> Column:
    """Bytes of a message row (role, content_type, content, kind, tags, metadata_json)."""
    c = lambda n: F.col(prefix + n)
    content = content_bytes(c("content_type"), c("content"), wide=wide)
    if wide:
        return F.lit(WIDE_MESSAGE) + content + literal_bytes(c("kind")) + json_bytes(c("metadata_json"), wide=True) + literal_bytes(c("role")) + tags_bytes(c("tags"), wide=True)
    return (
        F.lit(12) + content
        + F.when(c("kind") != "message", literal_bytes(c("kind")) + 8).otherwise(0)
        + F.when(c("metadata_json") != "{}", json_bytes(c("metadata_json"), wide=False) + 12).otherwise(0)
        + F.when(c("role") != "user", literal_bytes(c("role")) + 8).otherwise(0)
        + F.when(F.size(c("tags")) > 0, tags_bytes(c("tags"), wide=False) + 8).otherwise(0)
    )


def artifact_bytes(*, wide: bool, prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    content = content_bytes(c("content_type"), c("content"), wide=wide)
    if wide:
        return F.lit(WIDE_ARTIFACT) + content + literal_bytes(c("media_type")) + json_bytes(c("metadata_json"), wide=True) + literal_bytes(c("name"))
    return (
        F.lit(20) + content + literal_bytes(c("name"))
        + F.when(c("media_type") != "text/plain", literal_bytes(c("media_type")) + 14).otherwise(0)
        + F.when(c("metadata_json") != "{}", json_bytes(c("metadata_json"), wide=False) + 12).otherwise(0)
    )


def tokens(size: Column) -> Column:
    """Estimated tokens of so many UTF-8 bytes: none of none, else a quarter, rounded up."""
    return F.ceil(size / 4).cast("long")


def text_tokens(col: Column) -> Column:
    return tokens(F.octet_length(col))


def message_tokens(size: Column) -> Column:
    return tokens(size) + 4


def envelope_base(sender: Column, receiver: Column, metadata_json: Column) -> Column:
    return F.lit(WIDE_ENVELOPE) + json_bytes(metadata_json, wide=True) + literal_bytes(receiver) + literal_bytes(sender)


def packet_base(sender: Column, receiver: Column, goal: Column) -> Column:
    return F.lit(COMPACT_PACKET) + literal_bytes(goal) + literal_bytes(receiver) + literal_bytes(sender)


def separators(n: Column) -> Column:
    return F.greatest(n - 1, F.lit(0))
