"""Sinks: packets, audit rows, readable reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_packets(packets: DataFrame, path: str, *, by: str | None = None) -> None:
    """Packets as Parquet, a folder for each value of ``by`` if given."""
    w = packets.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def append_audit(reports: DataFrame, path: str) -> None:
    """One JSON line per report. Reports hold no contents."""
    reports.write.mode("append").json(path)


def each_report(reports: DataFrame, emit: Callable[[dict], None]) -> None:
    """Call back once a report, where the rows are."""

    def run(rows) -> None:
        for r in rows:
            emit(r.asDict(recursive=True))

    reports.foreachPartition(run)


def report_text() -> Column:
    """Readable lines of a report row."""
    number = lambda c: F.format_number(F.col(c).cast("double"), 0)
    return F.concat_ws(
        "\n",
        F.concat(F.col("sender"), F.lit(" -> "), F.col("receiver")), F.concat(F.lit("handoff: "), F.col("handoff_id").cast("string")), F.concat(F.lit("status: "), F.col("status")),
        F.concat(F.lit("original tokens (estimated): "), number("original_tokens")), F.concat(F.lit("transmitted tokens (estimated): "), number("transmitted_tokens")),
        F.concat(F.lit("estimated savings: "), F.format_string("%.1f%%", F.col("saved_percent"))), F.concat(F.lit("redactions: "), number("redactions")),
        F.concat(F.lit("duplicates removed: "), number("duplicates_removed")), F.concat(F.lit("protected messages: "), number("protected_messages")),
        F.concat(F.lit("failure: "), F.col("failure_code")),
    )


def budget_text() -> Column:
    """Readable lines of a compilation's budget row."""
    maps = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return F.concat_ws("\n", F.format_string("packet tokens: %d of %d, %d left", "packet_tokens", "max_tokens", "remaining_tokens"), F.format_string("required tokens: %d", "required_tokens"), F.concat(F.lit("omitted: "), F.coalesce(maps("omitted_before"), F.lit("none"))))
