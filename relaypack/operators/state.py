"""Sender state: the last word on each key counts, and what is completed is no longer pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions.text import is_blank
from relaypack.operators.frames import Frames
from relaypack.operators.policies import distinct_in_order
from relaypack.schema import SECTIONS


def explicit_section() -> Column:
    """Section named by kind or tags; null if none. ``n_sections`` tells if it is one."""
    return F.get(F.array_sort(explicit_sections()), 0)


def explicit_sections() -> Column:
    return F.array_intersect(F.array_union("tags", F.array("kind")), F.array(*map(F.lit, SECTIONS)))


def metadata_string(name: str) -> Column:
    return F.get_json_object("metadata_json", f"$.{name}")


def bad_metadata(name: str) -> Column:
    """A key that is there, but is no string or a blank one."""
    has = F.coalesce(F.array_contains(F.json_object_keys("metadata_json"), name), F.lit(False))
    kind = F.expr(f"schema_of_variant(variant_get(try_parse_json(metadata_json), '$.{name}', 'variant'))")
    return has & F.coalesce((kind != "STRING") | is_blank(metadata_string(name)), F.lit(True))


def last_writer(rows: DataFrame, group: list[str], section: str, key: str, place: str) -> DataFrame:
    """Adds ``alive``: the last row of its (group, section, key), and no pending row that a later one completes.

    Rows without a section or key all live. Two maxima over the key's rows decide, so no history is replayed.
    """
    keyed = F.col(section).isNotNull() & F.col(key).isNotNull()
    w = Window.partitionBy(*group, key)
    last = F.max(place).over(Window.partitionBy(*group, key, section))
    done = F.max(F.when(F.col(section) == "completed_work", F.col(place))).over(w)
    closed = (F.col(section) == "pending_work") & F.coalesce(done > F.col(place), F.lit(False))
    return rows.withColumn("alive", ~keyed | ((last == F.col(place)) & ~closed))


def in_scope(task: str | None) -> Column:
    if task is None:
        return F.lit(True)
    own = metadata_string("task_id")
    return own.isNull() | (own == task)


def prepare(f: Frames, task_id: str | None = None) -> Frames:
    """Scope, last writer wins, completed closes pending, exact repeats go. Bad task ids or state keys deny their handoff."""
    bad = bad_metadata("task_id") | bad_metadata("state_key")
    f = f.deny("state", "validation", f.messages.where(bad).select("handoff_id").union(f.artifacts.where(bad_metadata("task_id")).select("handoff_id")))
    many = f.messages.where(F.size(explicit_sections()) > 1).select("handoff_id")
    f = f.deny("state", "contract", many)
    m = f.messages.where(in_scope(task_id)).withColumns({"_s": explicit_section(), "_scope": metadata_string("task_id"), "_k": metadata_string("state_key")})
    m = last_writer(m, ["handoff_id", "_scope"], "_s", "_k", "msg_idx").where("alive").drop("alive", "_s", "_scope", "_k")
    same = ["handoff_id", "role", "content_type", "content", "kind", F.array_sort("tags"), "metadata_json"]
    m = distinct_in_order(m, same, "msg_idx")
    a = distinct_in_order(f.artifacts.where(in_scope(task_id)), ["handoff_id", "name", "media_type", "content_type", "content", "metadata_json"], "art_idx")
    return f.with_(messages=m, artifacts=a)
