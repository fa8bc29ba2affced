"""The report of a state: every table under a fixed key, as files of JSON rows or as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlog.functions.codes import result_code_name
from dirlog.functions.timestamps import NS, format_timestamp
from dirlog.operators import operations as O
from dirlog.operators import patterns as P
from dirlog.operators import stats as S
from dirlog.operators import timeline as L
from dirlog.operators.ranking import top_bases, top_filters
from dirlog.sources.state import errors

#: How a table becomes an object in the document. Its keys, from the outside in, and for one number a key the column that holds it.
OBJECTS = {
    "operation_counts": (("label",), "n"), "load_by_server": (("server",), None), "time_by_server": (("server",), None), "paged_search_by_app": (("account",), "pages"),
    "error_counts": (("code",), None), "error_counts_by_app": (("account", "code"), None), "extended_operations": (("oid",), None), "global_control_warnings": (("oid",), "n"),
    "csn_events": (("kind",), "n"), "not_indexed_attributes": (("attr",), "n"), "qmark_filter_attributes": (("attr",), "n"), "filter_families": (("account", "template"), None),
    "op_sequences": (("account", "sequence"), "n"), "cost_by_account": (("account",), None), "cost_by_type": (("type",), None), "bind_usage": (("what", "name"), "n"),
    "serverlog": (("what", "name"), "n"), "misc_counters": (("what",), "n"), "attribute_counts": (("attr",), "n"),
}


def listed(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, count, texts): counts of codes with all their texts. A row holds each distinct text of its key once."""
    counts = texts.withColumnRenamed("who", "account").groupBy(*keys, "err", "text").agg(F.sum("n").alias("n"))
    by = S.with_texts(counts, [*keys, "err"], None)
    return by.select(*keys, F.col("err").cast("string").alias("code"), result_code_name(F.col("err")).alias("name"), F.col("n").alias("count"), F.transform("texts", lambda t: F.struct(t["text"].alias("text"), t["n"].alias("count"))).alias("texts"))


def report_tables(state: dict[str, DataFrame], min_share: float = 20.0) -> dict[str, DataFrame]:
    """The report's tables, whole, by the key under which each is written; ``summary`` is one row of plain figures."""
    t = state
    percent = lambda part: F.round(part * 100, 4).alias("share")
    accounts, account_share = S.shared(t["accounts"])
    types, type_share = S.shared(t["types"].join(t["operation_counts"].select(F.col("label").alias("type"), F.col("n").alias("ops")), "type", "left").withColumn("ops", F.coalesce("ops", F.lit(0))))
    average = F.when(F.col("ops") > 0, F.col("etime_total") / F.col("ops")).otherwise(0.0).alias("avg_etime")
    families = t["families"].withColumn("etime_avg", F.col("etime_total") / F.col("n"))
    total = t["times"].where("what = 'etime'").select(F.col("total").alias("all"))
    hogs = P.hogs_of(families, total, min_share)
    figures = t["counters"].groupBy().pivot("what").agg(F.first("n"))
    spent = t["times"].groupBy().pivot("what", ["etime", "qtime"]).agg(F.first("total")).select(F.col("etime").alias("etime_total"), F.col("qtime").alias("qtime_total"))
    span = t["coverage"].agg(format_timestamp(F.min("first_ns")).alias("first_timestamp"), format_timestamp(F.max("last_ns")).alias("last_timestamp"), F.array_sort(F.collect_set("server")).alias("servers"))
    peak = L.peak_of(t["connections_timeline"]).select(F.col("peak").alias("peak_active_connections"))
    slow = t["slowest_operation"].agg(F.first("etime").alias("max_etime"), F.first("who").alias("max_etime_user"), F.first("description").alias("max_etime_desc"))
    slow_conn = t["slowest_connection"].agg(F.first("total_etime").alias("max_conn_etime"), F.first("who").alias("max_conn_etime_user"), F.first("description").alias("max_conn_etime_desc"))
    more = t["versions"].agg(F.min_by("version", "file").alias("openldap_version")).join(t["qmark_filters"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("qmark_filter_count"))).join(t["paged"].agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("paged_search_count")))
    summary = figures
    for one in (spent, span, peak, slow, slow_conn, more):
        summary = summary.join(F.broadcast(one))
    return {
        "summary": summary,
        "operation_counts": t["operation_counts"],
        "load_by_server": t["servers"].select(F.coalesce("server", F.lit("")).alias("server"), F.col("ops").alias("operations"), "etime_total", "connections", "failures"),
        "time_by_server": t["coverage"].select(F.coalesce("server", F.lit("")).alias("server"), format_timestamp(F.col("first_ns")).alias("first_timestamp"), format_timestamp(F.col("last_ns")).alias("last_timestamp")),
        "bind_usage": t["bind_usage"].unionByName(t["mechanisms"].select(F.lit("mechanism by lines").alias("what"), F.col("mech").alias("name"), "n")),
        "serverlog": t["server_logs"],
        "paged_search_by_app": t["paged"],
        "error_counts": listed(t["texts"].where("err is not null")),
        "error_counts_by_app": listed(errors(t), "account"),
        "top_bases": top_bases(t["bases"]),
        "top_filters": top_filters(t["filters"]),
        "top_operations": t["top_operations"],
        "top_connections": t["top_connections"],
        "session_correlations": O.distinct_correlations(t["correlations"]),
        "session_groups": S.session_groups(t["correlations"]),
        "extended_operations": t["extended_ops"].select("oid", "name", F.col("n").alias("count")),
        "global_control_warnings": t["global_controls"],
        "csn_events": t["csn_events"],
        "misc_counters": t["misc_counters"],
        "not_indexed_attributes": t["not_indexed"].where("attr is not null"),
        "qmark_filter_attributes": t["qmark_filters"],
        "attribute_counts": t["attributes"],
        "filters_one_entry": t["filters_one_entry"],
        "filters_no_entry": t["filters_no_entry"],
        "wildcard_filters": t["wildcard_filters"],
        "filters_per_account": t["account_filters"],
        "filter_families": families.select("account", "template", F.col("n").alias("count"), "etime_total", F.col("etime_avg").alias("avg_etime"), (F.col("entries") / F.col("n")).alias("avg_nentries"), F.col("entries_min").alias("nentries_min"), F.col("entries_max").alias("nentries_max")),
        "op_sequences": t["sequences"],
        "cost_by_account": accounts.select("account", "ops", "etime_total", average, percent(account_share)),
        "cost_by_type": types.select("type", "ops", "etime_total", average, percent(type_share)),
        "resource_hogs": hogs.select("account", "template", "etime_total", percent(F.col("share")), (F.col("etime_total") / F.col("n")).alias("avg_etime")),
        "top_consumer_per_hour": P.top_consumer_per_hour(t["hours"]).select(format_timestamp(F.col("hour") * (3600 * NS), "iso8601").alias("hour"), "account", F.col("etime_total").alias("etime")),
        "latency_histogram": t["latency"].orderBy("bucket"),
        "latency_density": t["density"].orderBy("bin"),
        "server_events": t["lifecycle"].select(format_timestamp(F.col("ts_ns")).alias("timestamp"), "server", "what", "label").orderBy("timestamp", "label"),
    }


def write_report(state: dict[str, DataFrame], path: str, min_share: float = 20.0) -> None:
    """Each table as JSON rows in a folder of its own, written by the tasks that hold them: no row passes the driver."""
    for name, df in report_tables(state, min_share).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def build_report(state: dict[str, DataFrame], min_share: float = 20.0) -> str:
    """The whole report as one JSON document. For states whose tables the driver can hold; ``write_report`` for others."""
    document: dict = {}
    for name, df in report_tables(state, min_share).items():
        rows = [json.loads(r) for r in df.toJSON().collect()]
        if name == "summary":
            document |= rows[0]
        elif name in OBJECTS:
            keys, value = OBJECTS[name]
            document[name] = nested(rows, keys, value)
        else:
            document[name] = rows
    return json.dumps(document, ensure_ascii=False)


def nested(rows: list[dict], keys: tuple[str, ...], value: str | None) -> dict:
    out: dict = {}
    for row in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(row.get(k, "")), {})
        at[str(row.get(keys[-1], ""))] = row.get(value) if value else {k: v for k, v in row.items() if k not in keys}
    return out
