"""What leaves: unknown lines and the replay table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlog.functions.codes import scope_name
from dirlog.functions.timestamps import format_timestamp
from dirlog.schema import UNKNOWN

#: Most unknown lines that are stored; the count is always exact.
UNKNOWN_LINES, REPLAY_ROWS = 100_000, 1_000_000


def unknown_lines(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*UNKNOWN)).select("raw")


def write_unknown_lines(events: DataFrame, path: str, limit: int = UNKNOWN_LINES) -> int:
    """Writes the text of up to ``limit`` unknown lines; returns how many there are."""
    rows = unknown_lines(events)
    rows.limit(limit).select(F.col("raw").alias("value")).write.mode("overwrite").text(path)
    return rows.count()


def replay_table(operations: DataFrame, date_format: str = "rfc3339") -> DataFrame:
    """One row for each operation, ended or in flight, in order of time, connection, operation and log.

    A time that is missing is the first of the run.
    """
    first = operations.agg(F.min(F.least("start_ts_ns", "end_ts_ns")).alias("first_ns"))
    rows = operations.join(F.broadcast(first))
    at = F.coalesce("start_ts_ns", "end_ts_ns", "first_ns")
    rows = rows.select(
        format_timestamp(at, date_format).alias("timestamp"), "server", "conn", "op", F.coalesce("type", F.lit("?")).alias("type"), "who", "binddn", "base", scope_name(F.col("scope")).alias("scope"), "filter", "attrs", "dn",
        "err", "nentries", "etime", "qtime", "text", at.alias("_at"), "file", "start_ord",
    )
    return rows.orderBy("_at", "conn", "op", "file", "start_ord").drop("_at", "file", "start_ord")


def write_replay(operations: DataFrame, path: str, sep: str = "|", limit: int = REPLAY_ROWS, date_format: str = "rfc3339") -> None:
    """The replay table as text with a separator: |, tab or comma; ``limit`` 0 writes all rows."""
    if sep not in ("|", "\t", ","):
        raise ValueError("the separator is |, a tab or a comma")
    rows = replay_table(operations, date_format)
    (rows.limit(limit) if limit else rows).write.mode("overwrite").csv(path, sep=sep, header=True)
