"""Table shapes of the engine. Order columns are explicit, since a DataFrame has no order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANDOFFS = "handoff_id bigint, sender string, receiver string, metadata_json string"
MESSAGES = "handoff_id bigint, msg_idx int, role string, content_type string, content string, kind string, tags array<string>, metadata_json string"
ARTIFACTS = "handoff_id bigint, art_idx int, name string, media_type string, content_type string, content string, metadata_json string"
ROUTES = "rule_ord int, rule_id string, sender_glob string, receiver_glob string"
CONTRACT = "contract_id string, goal string, required array<string>, preferred array<string>, max_tokens int, needs array<string>"

#: Sections in the order in which a packet flattens them.
SECTIONS = ("constraints", "decisions", "evidence", "completed_work", "failed_attempts", "pending_work", "artifacts", "tool_results")
#: Fields a public input may have, and those that only the engine may set.
MESSAGE_FIELDS = ("role", "content", "kind", "tags", "metadata")
RESERVED_FIELDS = ("protected", "internal", "_protected", "_internal")
ENGINE_COLUMNS = ("protected", "section", "src_key")


def section_order(section: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SECTIONS)), section).cast("int")
