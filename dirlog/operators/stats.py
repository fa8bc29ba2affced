"""Counts and sums over events and operations. Every table here is grouped with partial aggregation first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlog.functions import codes
from dirlog.functions.filters import nat_host_key, normalize_filter, qmark_attrs, session_name_key, split_attrs
from dirlog.operators.operations import completed
from dirlog.schema import READS, REQUEST_LABELS, UNKNOWN, WRITES

#: Times are added as decimals, so that a sum does not depend on the order of its parts.
MONEY = "decimal(28,9)"


def time_sum(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0)).cast("double")


def share(part: Column, of: Column) -> Column:
    return F.round(F.when(of > 0, part / of).otherwise(0.0), 6)


def label(kind: Column | str = "kind") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return codes.lookup(kind, REQUEST_LABELS)


def operation_counts(events: DataFrame) -> DataFrame:
    return events.select(label().alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


def read_write(events: DataFrame) -> DataFrame:
    """Reads and writes by request lines; a MOD's line of attributes counts as a further write."""
    return events.agg(F.count_if(F.col("kind").isin(*READS)).alias("reads"), F.count_if(F.col("kind").isin(*WRITES)).alias("writes"))


#: Types whose time makes the average of a data operation.
DATA = ("SRCH", "ADD", "MOD", "DEL", "MODRDN", "CMP", "EXT")


def summary_stats(events: DataFrame, operations: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """One row for the whole run. Lines, operations and connections are each read once.

    The slowest operation and connection are named with account and description; ties go to the smallest of both.
    """
    kind = F.col("kind")
    e = events.agg(
        F.count("*").alias("lines"), F.count_if(kind.isin(*UNKNOWN)).alias("unknown"), F.count_if(kind == "ACCEPT").alias("opened"), F.count_if(kind == "CLOSED").alias("closed"),
        F.count_if(kind.isin(*READS)).alias("reads"), F.count_if(kind.isin(*WRITES)).alias("writes"), F.count_if(kind.isin("CSN_GET", "CSN_QUEUE", "CSN_GRADUATE", "SYNCPROV")).alias("replication"),
        F.count_if(kind == "SLAPD_STARTING").alias("starts"), F.count_if(kind == "SERVER_LOG").alias("server_log"),
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.array_join(F.array_sort(F.collect_set("server")), ",").alias("servers"),
        F.min_by(openldap_version(), F.when(kind == "VERSION", F.struct("file", "ord"))).alias("version"),
    )
    done = completed(operations)
    o = done.agg(
        F.count("*").alias("operations"), time_sum("etime").alias("etime_total"), time_sum("qtime").alias("qtime_total"), F.round(F.avg(F.when(F.col("type").isin(*DATA), F.col("etime")).cast(MONEY)).cast("double"), 6).alias("etime_avg_data"),
        slowest(F.col("etime"), operation_description()).alias("_o"),
    )
    o = o.select("operations", "etime_total", "qtime_total", "etime_avg_data", (-F.col("_o.t")).alias("etime_max"), F.col("_o.who").alias("etime_max_who"), F.col("_o.about").alias("etime_max_what"))
    out = e.join(o)
    if connections is None:
        return out
    c = connections.agg(slowest(F.col("total_etime"), F.concat(F.lit("conn="), F.col("conn").cast("string"))).alias("_c"))
    return out.join(c.select((-F.col("_c.t")).alias("connection_max"), F.col("_c.who").alias("connection_max_who"), F.col("_c.about").alias("connection_max_what")))


def summary_counts(events: DataFrame) -> DataFrame:
    """One row of plain counters, which states add up."""
    kind = F.col("kind")
    return events.agg(
        F.count("*").alias("lines"), F.count_if(kind.isin(*UNKNOWN)).alias("unknown_lines"), F.count_if(kind == "ACCEPT").alias("connections_opened"), F.count_if(kind == "CLOSED").alias("connections_closed"),
        F.count_if(kind.isin(*READS)).alias("read_operations"), F.count_if(kind.isin(*WRITES)).alias("write_operations"),
        F.count_if(kind.isin("CSN_GET", "CSN_QUEUE", "CSN_GRADUATE", "SYNCPROV")).alias("replication_lines"), F.count_if(kind == "SLAPD_STARTING").alias("starts"),
        F.count_if(kind == "SERVER_LOG").alias("serverlog_entries"), F.count_if("not_indexed").alias("not_indexed_count"), F.count_if(F.col("kind").isin("BIND", "BIND_ANON")).alias("binds"),
    )


def slowest(time: Column, about: Column) -> Column:
    """The row with the most time, then the smallest account and description: a struct with the negative time."""
    return F.min(F.when(time.isNotNull(), F.struct((-time).alias("t"), "who", about.alias("about"))))


def operation_description() -> Column:
    return F.concat_ws(" ", "type", F.coalesce("base", "dn"), "filter")


def openldap_version() -> Column:
    """The version in a banner line."""
    return F.nullif(F.regexp_extract("raw", r"\$OpenLDAP: slapd\s+(?:\S+\s+)?(\d+\.\d+[^\s(]*)", 1), F.lit(""))


def texts_by_code(operations: DataFrame, failing: bool = False) -> DataFrame:
    """(who, err, text, n): every text of every code, whole and flat; of failing codes only if asked."""
    rows = completed(operations).where(codes.is_error(F.col("err")) if failing else F.col("err").isNotNull())
    return rows.groupBy("who", "err", "text").agg(F.count("*").alias("n"))


def with_texts(counts: DataFrame, keys: list[str], keep: int | None) -> DataFrame:
    """(keys, n, texts): sums over the texts, and all texts, or the ``keep`` most frequent; ties by text, in order.

    With ``keep`` Spark cuts each task's rows to the first ``keep`` of a key before it shuffles them. Without,
    a row holds each distinct text of its key once.
    """
    if keep is None:
        listed = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct((-F.col("n")).alias("k"), "text", "n"))))
        out = counts.groupBy(*keys).agg(F.sum("n").alias("n"), listed.alias("texts"))
        return out.withColumn("texts", F.transform("texts", lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n"))))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "text")
    best = counts.where("text is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "text", "n"))), lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))
    texts = best.groupBy(*keys).agg(listed.alias("texts"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n")).join(texts, keys, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<struct<text:string,n:bigint>>")))


def result_codes(operations: DataFrame, keep: int | None = None) -> DataFrame:
    """Per code: name, class, count, and its texts with counts, the most frequent first; only ``keep`` if asked."""
    counts = texts_by_code(operations).groupBy("err", "text").agg(F.sum("n").alias("n"))
    out = with_texts(counts, ["err"], keep)
    return out.select("err", codes.result_code_name(F.col("err")).alias("name"), codes.result_code_class(F.col("err")).alias("class"), "n", "texts")


def errors_per_account(operations: DataFrame, keep: int | None = None) -> DataFrame:
    """Failing codes per account with that account's own texts, the most frequent first; only ``keep`` if asked."""
    out = with_texts(texts_by_code(operations, failing=True), ["who", "err"], keep)
    texts = F.array_join(F.transform("texts", lambda s: F.concat(s["text"], F.lit(" x"), s["n"].cast("string"))), "; ")
    return out.select(F.col("who").alias("account"), F.col("err").alias("code"), codes.result_code_name(F.col("err")).alias("name"), "n", texts.alias("texts"))


def codes_by_class(operations: DataFrame) -> DataFrame:
    rows, part = shared(completed(operations).where("err is not null").groupBy(codes.result_code_class(F.col("err")).alias("class")).agg(F.count("*").alias("n")), "n")
    return rows.select("class", "n", part.alias("share"))


def base_stats(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Per search base: requests (lines) and time spent (results)."""
    asked = events.where("kind = 'SRCH' and base is not null").select("base", F.lit(1).alias("n"), F.lit(None).cast(MONEY).alias("t"))
    took = completed(operations).where("type = 'SRCH' and base is not null").select("base", F.lit(0).alias("n"), F.col("etime").cast(MONEY).alias("t"))
    return asked.union(took).groupBy("base").agg(F.sum("n").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("etime_total"))


def with_filter_key(df: DataFrame) -> DataFrame:
    return df.withColumn("filter", normalize_filter(F.col("filter"))).where("filter is not null")


def filter_stats(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Per normalised filter: requests and time spent."""
    asked = with_filter_key(events.where("kind = 'SRCH'")).select("filter", F.lit(1).alias("n"), F.lit(None).cast(MONEY).alias("t"))
    took = with_filter_key(completed(operations)).select("filter", F.lit(0).alias("n"), F.col("etime").cast(MONEY).alias("t"))
    return asked.union(took).groupBy("filter").agg(F.sum("n").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("etime_total"))


def filters_by_entries(operations: DataFrame, entries: int) -> DataFrame:
    """Filters of searches that found exactly so many entries: 1 or 0."""
    return with_filter_key(completed(operations).where(F.col("nentries") == entries)).groupBy("filter").agg(F.count("*").alias("n"))


def wildcard_filters(events: DataFrame) -> DataFrame:
    return with_filter_key(events.where("kind = 'SRCH'")).where(F.col("filter").contains("*")).groupBy("filter").agg(F.count("*").alias("n"))


def filters_per_account(operations: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent filters of each account, ties by filter; tasks keep n of an account before they shuffle."""
    counts = with_filter_key(completed(operations)).groupBy("who", "filter").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("n"), "filter"))
    return counts.select(F.col("who").alias("account"), rank.alias("rank"), "filter", "n").where(F.col("rank") <= n)


def attribute_counts(events: DataFrame) -> DataFrame:
    """Requested and modified attributes, in lower case."""
    lines = events.where("kind in ('SRCH_ATTR', 'MOD') and attrs is not null")
    return lines.select(F.explode(split_attrs(F.col("attrs"))).alias("attr")).groupBy("attr").agg(F.count("*").alias("n"))


def account_stats(operations: DataFrame) -> DataFrame:
    return completed(operations).groupBy(F.col("who").alias("account")).agg(F.count("*").alias("ops"), time_sum("etime").alias("etime_total"))


def extended_ops(events: DataFrame) -> DataFrame:
    return events.where("kind = 'EXT'").groupBy("oid").agg(F.count("*").alias("n")).withColumn("name", codes.ext_oid_name(F.col("oid")))


def global_controls(events: DataFrame) -> DataFrame:
    return events.where("kind in ('GLOBAL_CONTROL', 'GET_CTRLS')").groupBy("oid").agg(F.count("*").alias("n"))


def qmark_filters(events: DataFrame) -> DataFrame:
    """Unknown attributes in filters: how often each stands in one."""
    return events.where("kind = 'SRCH'").select(F.explode(qmark_attrs(F.col("filter"))).alias("attr")).groupBy("attr").agg(F.count("*").alias("n"))


def csn_events(events: DataFrame) -> DataFrame:
    return events.where("kind in ('CSN_GET', 'CSN_QUEUE', 'CSN_GRADUATE')").groupBy("kind").agg(F.count("*").alias("n"))


MISC = {"CONTROL_NOT_SUPPORTED": "control not supported", "DO_BIND_INVALID": "invalid DN", "LDAP_BACK_RETRY": "backend retry", "CONN_DEFER": "deferred operation", "LDAP_BACK_DOBINT": "rebind failed"}


def misc_counters(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*MISC)).groupBy(codes.lookup(F.col("kind"), MISC).alias("what")).agg(F.count("*").alias("n"))


def not_indexed(events: DataFrame) -> DataFrame:
    """Searches without index per attribute; the attribute is null where a result only says so."""
    return events.where("not_indexed").groupBy(F.when(F.col("kind") == "NOT_INDEXED", F.lower("attrs")).alias("attr")).agg(F.count("*").alias("n"))


def server_log_counts(events: DataFrame) -> DataFrame:
    """Entries of errors logs per severity and per subsystem."""
    rows = events.where("kind = 'SERVER_LOG'").select(F.explode(F.array(F.struct(F.lit("severity").alias("what"), F.col("reason").alias("name")), F.struct(F.lit("subsystem").alias("what"), F.col("attrs").alias("name")))).alias("x"))
    return rows.where("x.name is not null").groupBy("x.what", "x.name").agg(F.count("*").alias("n"))


def bind_usage(binds: DataFrame) -> DataFrame:
    """Binds by method, transport and mechanism, and with session control, from one pass."""
    sasl = F.when(F.col("method") == "SASL", F.col("mech"))
    keys = F.array(*[F.struct(F.lit(w).alias("what"), c.alias("name")) for w, c in (("method", F.col("method")), ("transport", F.col("transport")), ("mechanism", sasl), ("session control", F.when(F.col("session_control"), F.lit("yes"))))])
    return binds.select(F.explode(keys).alias("x")).where("x.name is not null").groupBy("x.what", "x.name").agg(F.count("*").alias("n"))


def sasl_mechanisms(events: DataFrame) -> DataFrame:
    """SASL mechanisms from the lines that follow a bind."""
    lines = events.where("kind = 'BIND_DN_INFO' and mech is not null and upper(mech) not in ('SIMPLE', 'IMPLICIT')")
    return lines.groupBy("mech").agg(F.count("*").alias("n"))


def load_by_server(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations, share, time, connections and failures per server; servers with either lines of connections or results."""
    done = completed(operations).select("server", F.lit(1).alias("ops"), F.col("etime").cast(MONEY).alias("t"), F.lit(0).alias("connections"), codes.is_error(F.col("err")).cast("int").alias("failures"))
    conns = events.where("kind = 'ACCEPT'").select("server", F.lit(0).alias("ops"), F.lit(None).cast(MONEY).alias("t"), F.lit(1).alias("connections"), F.lit(0).alias("failures"))
    sums = [F.sum("ops").alias("ops"), time_sum("t").alias("etime_total"), F.sum("connections").alias("connections"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures")]
    rows = done.union(conns).groupBy("server").agg(*sums)
    total = rows.agg(F.sum("ops").alias("_all"), F.sum("etime_total").alias("_t"), F.sum("connections").alias("_c"), F.sum("failures").alias("_f"))
    return rows.join(F.broadcast(total)).select("server", "ops", share(F.col("ops"), F.col("_all")).alias("share"), "etime_total", "connections", "failures")


def coverage_by_server(events: DataFrame) -> DataFrame:
    return events.where("ts_ns is not null").groupBy("server").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def shared(rows: DataFrame, value: str = "etime_total") -> tuple[DataFrame, Column]:
    """Report rows joined with their total, and each row's share of it. The total is added up from the grouped rows.

    It asks for every column, so that Spark finds the same grouping on both sides and does it once.
    """
    every = rows.agg(F.sum(F.col(value).cast(MONEY)).cast("double").alias("_all"), *[F.max(c).alias(f"_m{i}") for i, c in enumerate(rows.columns)])
    some = F.coalesce(*[F.when(F.col(f"_m{i}").isNotNull(), True) for i in range(len(rows.columns))])
    return rows.join(F.broadcast(every)), share(F.col(value), F.when(some, F.col("_all")))


def cost_by_account(operations: DataFrame) -> DataFrame:
    """Operations, time, average and share of all time per account."""
    rows, part = shared(account_stats(operations))
    return rows.select("account", "ops", "etime_total", F.round(F.col("etime_total") / F.col("ops"), 6).alias("etime_avg"), part.alias("share"))


def cost_by_type(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Time of results per type against the request lines with that label."""
    took = completed(operations).where("type is not null").select("type", F.col("etime").cast(MONEY).alias("t"), F.lit(0).alias("n"), F.lit(True).alias("ended"))
    asked = events.select(label().alias("type"), F.lit(None).cast(MONEY).alias("t"), F.lit(1).alias("n"), F.lit(False).alias("ended")).where("type is not null")
    sums = took.union(asked).groupBy("type").agg(F.sum("n").alias("ops"), time_sum("t").alias("etime_total"), F.max("ended").alias("ended"))
    rows, part = shared(sums.where("ended"))
    average = F.round(F.when(F.col("ops") > 0, F.col("etime_total") / F.col("ops")).otherwise(0.0), 6)
    return rows.select("type", "ops", "etime_total", average.alias("etime_avg"), part.alias("share"))


def latency_histogram(operations: DataFrame) -> DataFrame:
    """Operations per latency bucket, empty ones too."""
    found = completed(operations).where("etime is not null").groupBy(codes.etime_bucket(F.col("etime")).alias("b")).agg(F.count("*").alias("n"))
    bins = operations.sparkSession.range(len(codes.BOUNDS) + 1).select(F.col("id").cast("int").alias("bucket"))
    return bins.join(F.broadcast(found), F.col("bucket") == F.col("b"), "left").select("bucket", codes.bucket_label(F.col("bucket")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def latency_density(operations: DataFrame) -> DataFrame:
    """Operations per logarithmic bin, empty ones too."""
    found = completed(operations).where("etime is not null").groupBy(codes.etime_log_bin(F.col("etime")).alias("b")).agg(F.count("*").alias("n"))
    bins = operations.sparkSession.range(codes.LOG_BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(found), F.col("bin") == F.col("b"), "left").select("bin", codes.log_bin_label(F.col("bin")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def session_groups(correlations: DataFrame, approximate: bool = False) -> DataFrame:
    """Sessions and distinct hosts behind address translation per (name, real address, user, bind DN), busiest first."""
    hosts = (F.approx_count_distinct if approximate else F.countDistinct)(nat_host_key(F.col("accept"))).alias("nat_hosts")
    keys = [session_name_key(F.col("name")).alias("name"), "real_ip", "username", "binddn"]
    return correlations.groupBy(*keys).agg(F.count("*").alias("sessions"), hosts).orderBy(F.desc("sessions"), "name", "real_ip", "username", "binddn")


def paged_searches(*parts: DataFrame) -> DataFrame:
    """Pages per account over the ways of finding them (who, pages)."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy(F.col("who").alias("account")).agg(F.sum("pages").alias("pages"))


def resource_consumers(operations: DataFrame) -> DataFrame:
    """Share of each account in all time, or in all operations where no time was spent."""
    rows = account_stats(operations)
    total = rows.agg(F.sum(F.col("etime_total").cast(MONEY)).cast("double").alias("all_etime"), F.sum("ops").alias("all_ops"))
    by_time = F.col("all_etime") > 0
    metric = F.when(by_time, F.col("etime_total")).otherwise(F.col("ops"))
    return rows.join(F.broadcast(total)).select("account", F.when(by_time, "etime").otherwise("ops").alias("metric"), share(metric, F.when(by_time, F.col("all_etime")).otherwise(F.col("all_ops"))).alias("share"))
