"""Pluggable token counters: a column expression for texts, and a fit for counters that aren't additive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaypack.functions import tokens as tk
from relaypack.functions.arrow import arrow_function


@dataclass(frozen=True)
class TokenCounter:
    """``column`` counts texts in a plan, ``text`` one text where the rows are. ``message_extra`` is added for each message or envelope."""

    name: str
    column: Callable[[Column], Column]
    text: Callable[[str], int]
    additive: bool = False
    message_extra: int = 4


APPROX = TokenCounter("approx", tk.text_tokens, lambda t: -(-len(t.encode()) // 4), additive=True)


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tiktoken_counter(ranks_path: str, pattern: str, *, name: str = "tiktoken") -> TokenCounter:
    """Counts by a vocabulary file that every executor can read; special tokens' strings are ordinary text."""

    def one(text: str) -> int:
        return len(_encoding(ranks_path, pattern).encode_ordinary(text))

    @arrow_function("bigint")
    def many(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if t is not None else None).astype("Int64")

    return TokenCounter(name, many, one)


def counted(packets: DataFrame, counter: TokenCounter) -> DataFrame:
    """Packets with ``packet_tokens`` by another counter."""
    return packets.withColumn("packet_tokens", counter.column(F.col("receiver_text")).cast("long"))


def fit_counted(items: DataFrame, heads: DataFrame, counter: TokenCounter, max_tokens: int) -> DataFrame:
    """handoff_id, pos, kept: required items, then the others in order while the whole text fits, by any counter.

    ``items``: handoff_id, ord, pos, required, item; ``heads``: handoff_id, before, after (the text around the items). Each trial counts the
    whole text, one handoff at a time; additive counters need none of it (``fit``). Required items over the limit give no row.
    """

    def run(rows: pa.Table, head: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bool]] = []
        if head.num_rows and rows.num_rows:
            h = head.to_pylist()[0]
            every = sorted(rows.to_pylist(), key=lambda r: (r["ord"], r["pos"]))
            size = lambda kept: counter.text(h["before"] + ",".join(r["item"] for r in every if r["pos"] in kept) + h["after"])
            kept = {r["pos"] for r in every if r["required"]}
            if size(kept) <= max_tokens:
                for r in every:
                    if not r["required"] and size(kept | {r["pos"]}) <= max_tokens:
                        kept.add(r["pos"])
                out = [(h["handoff_id"], r["pos"], r["pos"] in kept) for r in every]
        return pa.table({"handoff_id": pa.array([x[0] for x in out], pa.int64()), "pos": pa.array([x[1] for x in out], pa.int64()), "kept": pa.array([x[2] for x in out], pa.bool_())})

    return items.select("handoff_id", "ord", F.col("pos").cast("bigint").alias("pos"), "required", "item").groupBy("handoff_id").cogroup(heads.select("handoff_id", "before", "after").groupBy("handoff_id")).applyInArrow(run, "handoff_id bigint, pos bigint, kept boolean")
