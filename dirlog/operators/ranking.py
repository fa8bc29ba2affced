"""Top rows, shares and folded tails, with the tie order of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_OPERATIONS = ("conn", "op", "type", "base", "filter", "who", "attrs", "scope", "deref", "binddn", "authcid", "authzid", "nentries", "err", "qtime", "text", "end_ts_ns", "server")
TOP_CONNECTIONS = ("conn", "who", "src", "ops_count", "binddn", "reason", "server")


def top_operations(operations: DataFrame, n: int = 100) -> DataFrame:
    """The slowest completed operations in a total order."""
    done = operations.where("end_kind in ('RESULT', 'SEARCH_RESULT')")
    return done.orderBy(F.desc_nulls_last("etime"), *[F.asc_nulls_first(c) for c in TOP_OPERATIONS]).limit(n)


def top_connections(connections: DataFrame, n: int = 100) -> DataFrame:
    """The closed connections with the most time spent, in a total order."""
    return connections.orderBy(F.desc("total_etime"), *[F.asc_nulls_first(c) for c in TOP_CONNECTIONS]).limit(n)


def slowest_operation(operations: DataFrame) -> DataFrame:
    """The one with the longest etime; ties go to the smallest account, then description."""
    return operations.where("etime is not null").select("who", F.concat_ws(" ", "type", F.coalesce("base", "dn"), "filter").alias("description"), "etime").orderBy(F.desc("etime"), "who", "description").limit(1)


def slowest_connection(connections: DataFrame) -> DataFrame:
    about = F.concat(F.lit("conn="), F.col("conn").cast("string"))
    return connections.select("who", about.alias("description"), "total_etime").orderBy(F.desc("total_etime"), "who", "description").limit(1)


def ranked(df: DataFrame, key: str, value: str, n: int = 20, tie: str = "asc") -> DataFrame:
    """The n largest by value; ties by key upwards (plain counters) or downwards (tables with times)."""
    return df.orderBy(F.desc(value), F.desc(key) if tie == "desc" else F.asc(key)).limit(n)


def compact(df: DataFrame, value: str, key: str, keep: int = 10, share: float = 0.01) -> DataFrame:
    """The first ``keep`` rows, then those with ``share`` of the total; df is one report table, already grouped, key unique.

    The last of the first rows and the total are one row, which is broadcast; no task sees the whole table.
    """
    first = df.orderBy(F.desc(value), F.asc(key)).limit(keep).agg(F.max(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("_last"))
    edge = first.join(df.agg(F.sum(value).alias("_all")))
    top = F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")) <= F.col("_last")
    return df.join(F.broadcast(edge)).where(top | (F.col(value) >= F.col("_all") * share)).drop("_last", "_all")


def keep_top(df: DataFrame, n: int, label: str, value: str, other: str = "other", by: list[str] | None = None) -> DataFrame:
    """The n labels with the largest sums; the rest of the rows is added up under ``other``, within ``by``."""
    best = df.groupBy(label).agg(F.sum(value).alias("_s")).orderBy(F.desc("_s"), label).limit(n).select(F.col(label).alias("_l"))
    named = df.join(F.broadcast(best), F.col(label).eqNullSafe(F.col("_l")), "left")
    name: Column = F.coalesce("_l", F.lit(other))
    return named.groupBy(*(by or []), name.alias(label)).agg(F.sum(value).alias(value))


def top_bases(bases: DataFrame, n: int = 20) -> DataFrame:
    return ranked(bases, "base", "n", n, tie="desc")


def top_filters(filters: DataFrame, n: int = 20) -> DataFrame:
    return ranked(filters, "filter", "n", n, tie="desc")
