"""Time series: open connections, errors, outages and what the logs do not cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlog.functions import codes
from dirlog.functions.timestamps import NS, div
from dirlog.operators.operations import completed
from dirlog.operators.ranking import keep_top
from dirlog.operators.stats import label
from dirlog.session import stored

STOPS = ("SLAPD_STOPPED", "SLAPD_SHUTDOWN", "DAEMON_SHUTDOWN")


def connection_events(events: DataFrame) -> DataFrame:
    """(t second, file, server, ord, delta) of openings and closings."""
    delta = F.when(F.col("kind") == "ACCEPT", 1).when(F.col("kind") == "CLOSED", -1)
    return events.select(div(F.col("ts_ns"), NS).alias("t"), "file", "server", "ord", delta.alias("delta")).where("delta is not null and t is not null")


def concurrency(deltas: DataFrame, by: tuple[str, ...] = (), order: tuple[str, ...] = ("t", "file", "ord")) -> DataFrame:
    """Adds open: connections after each event, never below none.

    Clamping at zero is a subtraction of the lowest running sum so far. With ``by`` each group is a timeline of
    its own; a timeline over everything takes ``concurrency_scan`` where it is long.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = deltas.withColumn("_sum", F.sum("delta").over(w))
    return rows.withColumn("open", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def concurrency_scan(deltas: DataFrame, by: tuple[str, ...] = (), ranges: int | None = None, order: tuple[str, ...] = ("t", "file", "ord")) -> DataFrame:
    """The same in two passes over ranges of time: no task sees more than a range of one timeline.

    deltas is read three times, so it should be a stored table. Ranges are cut by approximate quantiles of the time.
    Each range of a timeline comes down to two numbers, its sum and its lowest running sum; how many connections
    were open before it follows from those of the ranges before, in a table of one row a range and timeline.
    """
    n = ranges or max(1, int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(deltas.approxQuantile(order[0], [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    rows = deltas.withColumn("_part", part.cast("int")).withColumn("_sum", F.sum("delta").over(w))
    rows = rows.withColumn("_low", F.min("_sum").over(w))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_part").agg(F.sum("delta").alias("all"), F.min("_sum").alias("least"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    parts = parts.withColumn("_floor", F.coalesce(F.min(F.col("_before") + F.col("least")).over(earlier), F.lit(0)))
    keys = [F.col(c).alias(f"_{c}") for c in by]
    parts = parts.select(*keys, F.col("_part").alias("_p"), "_before", "_floor")
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    low = F.least(F.lit(0), F.col("_floor"), F.col("_before") + F.col("_low"))
    return rows.join(parts, same).select(*deltas.columns, (F.col("_before") + F.col("_sum") - low).alias("open"))


def peak_connections(events: DataFrame) -> DataFrame:
    """One server: the highest peak of any file. Several: the peak of all timelines merged, second by second."""
    return peak_of(stored(connection_events(events)))


def peak_of(deltas: DataFrame) -> DataFrame:
    """The same of a stored table of openings and closings."""
    servers = deltas.agg(F.countDistinct("server")).first()[0]
    rows = concurrency_scan(deltas, ("file",), order=("t", "ord")) if servers <= 1 else concurrency_scan(deltas)
    return rows.agg(F.max("open").alias("peak"))


def bucket(t: Column, t0: Column, t1: Column, buckets: int) -> Column:
    """Equal parts of the window from t0 to t1, the last closed."""
    width = F.greatest(F.lit(1), t1 - t0 + 1)
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.call_function("div", (t - t0) * buckets, width))).cast("int")


def concurrency_series(events: DataFrame, buckets: int = 240) -> DataFrame:
    """(bucket, peak): most open connections in each part of the run; an empty part goes on with the last value."""
    window = events.agg(div(F.min("ts_ns"), NS).alias("t0"), div(F.max("ts_ns"), NS).alias("t1"))
    rows = concurrency_scan(stored(connection_events(events))).join(F.broadcast(window))
    rows = rows.withColumn("bucket", bucket(F.col("t"), F.col("t0"), F.col("t1"), buckets))
    last = F.max_by("open", F.struct("t", "file", "ord"))
    found = rows.groupBy("bucket").agg(F.max("open").alias("most"), last.alias("last"))
    grid = events.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left")
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last("last", ignorenulls=True).over(w), F.lit(0))
    return grid.select("bucket", F.greatest(F.coalesce("most", F.lit(0)), before).alias("peak"))


def error_series(events: DataFrame, operations: DataFrame, buckets: int = 240, keep: int = 6) -> DataFrame:
    """(code, bucket, n): failing results over the run; the codes after the first ``keep`` as other."""
    window = events.agg(div(F.min("ts_ns"), NS).alias("t0"), div(F.max("ts_ns"), NS).alias("t1"))
    bad = completed(operations).where(codes.is_error(F.col("err")) & F.col("end_ts_ns").isNotNull()).join(F.broadcast(window))
    at = bucket(div(F.col("end_ts_ns"), NS), F.col("t0"), F.col("t1"), buckets)
    counts = bad.groupBy(F.col("err").cast("string").alias("code"), at.alias("bucket")).agg(F.count("*").alias("n"))
    return keep_top(counts, keep, "code", "n", by=["bucket"])


def server_events(events: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Starts, stops and shutdowns in order, with the version where one is known."""
    what = F.when(F.col("kind") == "SLAPD_STARTING", "start").when(F.col("kind") == "SLAPD_STOPPED", "stop").when(F.col("kind").isin(*STOPS), "shutdown")
    rows = events.select("file", "server", "ord", "ts_ns", what.alias("what")).where("what is not null")
    rows = rows.join(versions, "file", "left") if versions is not None else rows.withColumn("version", F.lit(None).cast("string"))
    text = F.concat(F.col("what"), F.when((F.col("what") == "start") & F.col("version").isNotNull(), F.concat(F.lit(" (OpenLDAP "), F.col("version"), F.lit(")"))).otherwise(F.lit("")))
    return rows.select("file", "server", "ord", "ts_ns", "what", text.alias("label")).orderBy("ts_ns", "file", "ord")


def in_time(lifecycle: DataFrame) -> DataFrame:
    """Adds t (second) and before (the event before it in time, whatever its file and server).

    lifecycle is ``server_events``: starts and stops of servers, a handful of rows, put in one order over all files,
    because a stop and the start after it lie in two files where logs are rotated. Within a second the labels decide.
    """
    rows = lifecycle.where("ts_ns is not null").withColumn("t", div(F.col("ts_ns"), NS))
    return rows.withColumn("before", F.lag("what").over(Window.orderBy("t", "label", "file", "ord")))


def outages(lifecycle: DataFrame, end_ns: Column | int) -> DataFrame:
    """(down_ns, up_ns): from the first stop or shutdown after a start to the next start, else to the end; whole seconds.

    Outages without length are left out. Which of them are backed by silence is what ``corroborated_outages`` tells.
    """
    end = F.lit(end_ns) if isinstance(end_ns, int) else end_ns
    edges = in_time(lifecycle).where("what = 'start' and before <> 'start' or what <> 'start' and coalesce(before, 'start') = 'start'")
    up = F.lead("t").over(Window.orderBy("t", "label", "file", "ord"))
    rows = edges.withColumn("up", F.coalesce(up, div(end, NS))).where("what <> 'start' and up > t")
    return rows.select((F.col("t") * NS).alias("down_ns"), (F.col("up") * NS).alias("up_ns"))


def corroborated_outages(down: DataFrame, events: DataFrame) -> DataFrame:
    """Outages during which no connection was opened or closed; the few outages are held against the lines where these lie."""
    conns = events.where("kind in ('ACCEPT', 'CLOSED')").select((div(F.col("ts_ns"), NS) * NS).alias("at"))
    numbered = stored(down)
    busy = conns.join(F.broadcast(numbered), (F.col("at") > F.col("down_ns")) & (F.col("at") < F.col("up_ns"))).select(*down.columns).distinct()
    return numbered.join(busy, down.columns, "left_anti")


def abrupt_restarts(lifecycle: DataFrame) -> DataFrame:
    """Starts, but for the first event, with nothing shut down since the start before."""
    return in_time(lifecycle).where("what = 'start' and before = 'start'").select("file", "server", "ts_ns")


def uncovered_spans(coverage: DataFrame) -> DataFrame:
    """(from_ns, to_ns): parts of the run that no server's log covers; none with a single server.

    coverage: (server, first_ns, last_ns), one row a server.
    """
    w = Window.orderBy("first_ns", "last_ns")
    rows = coverage.withColumns({"reached": F.max("last_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where("reached is not null and first_ns > reached").select(F.col("reached").alias("from_ns"), F.col("first_ns").alias("to_ns"))


def activity_by_bucket(events: DataFrame, buckets: int = 240) -> DataFrame:
    """(label, bucket, n): lines of each kind over the run."""
    window = events.agg(div(F.min("ts_ns"), NS).alias("t0"), div(F.max("ts_ns"), NS).alias("t1"))
    rows = events.where("ts_ns is not null").withColumn("label", label()).where("label is not null").join(F.broadcast(window))
    return rows.groupBy("label", bucket(div(F.col("ts_ns"), NS), F.col("t0"), F.col("t1"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
