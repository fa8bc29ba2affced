"""Saved partial tables: a later run goes on without parsing again, and states merge in any order.

A state holds, as small tables, everything that the report says. Each table has keys by which its rows are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlog.functions.codes import is_error
from dirlog.functions.timestamps import NS, div
from dirlog.operators import operations as O
from dirlog.operators import patterns as P
from dirlog.operators import stats as S
from dirlog.operators import timeline as L
from dirlog.operators.ranking import slowest_connection, slowest_operation, top_connections, top_operations
from dirlog.operators.stats import MONEY
from dirlog.schema import UNKNOWN
from dirlog.session import stored

VERSION = 2
#: How a table merges: its keys, and what becomes of each other column (sum, money, min, max).
RULES = {
    "counters": (["what"], {"n": "sum"}),
    "times": (["what"], {"total": "money"}),
    "versions": (["file"], {"version": "min"}),
    "operation_counts": (["label"], {"n": "sum"}),
    "texts": (["who", "err", "text"], {"n": "sum"}),
    "accounts": (["account"], {"ops": "sum", "etime_total": "money"}),
    "types": (["type"], {"etime_total": "money"}),
    "servers": (["server"], {"ops": "sum", "etime_total": "money", "connections": "sum", "failures": "sum"}),
    "bases": (["base"], {"n": "sum", "etime_total": "money"}),
    "filters": (["filter"], {"n": "sum", "etime_total": "money"}),
    "filters_one_entry": (["filter"], {"n": "sum"}),
    "filters_no_entry": (["filter"], {"n": "sum"}),
    "wildcard_filters": (["filter"], {"n": "sum"}),
    "account_filters": (["account", "filter"], {"n": "sum"}),
    "attributes": (["attr"], {"n": "sum"}),
    "qmark_filters": (["attr"], {"n": "sum"}),
    "not_indexed": (["attr"], {"n": "sum"}),
    "extended_ops": (["oid", "name"], {"n": "sum"}),
    "global_controls": (["oid"], {"n": "sum"}),
    "csn_events": (["kind"], {"n": "sum"}),
    "misc_counters": (["what"], {"n": "sum"}),
    "server_logs": (["what", "name"], {"n": "sum"}),
    "bind_usage": (["what", "name"], {"n": "sum"}),
    "mechanisms": (["mech"], {"n": "sum"}),
    "paged": (["account"], {"pages": "sum"}),
    "families": (["account", "template"], {"n": "sum", "etime_total": "money", "entries": "sum", "entries_min": "min", "entries_max": "max"}),
    "sequences": (["account", "sequence", "length"], {"n": "sum"}),
    "hours": (["hour", "account"], {"etime_total": "money"}),
    "coverage": (["server"], {"first_ns": "min", "last_ns": "max"}),
    "latency": (["bucket", "label"], {"n": "sum"}),
    "density": (["bin", "label"], {"n": "sum"}),
    "error_times": (["t", "err"], {"n": "sum"}),
    "lifecycle": (["file", "server", "ord", "ts_ns", "what", "label"], {}),
    "connections_timeline": (["t", "server", "file", "ord", "delta"], {}),
}
#: Tables that are cut again after a merge.
TOPS = {"top_operations": top_operations, "top_connections": top_connections, "slowest_operation": lambda df: df.orderBy(F.desc("etime"), "who", "description").limit(1), "slowest_connection": lambda df: df.orderBy(F.desc("total_etime"), "who", "description").limit(1), "unknown_lines": lambda df: df.orderBy("raw").limit(UNKNOWN_LINES)}
#: Unknown lines whose text is kept; all are counted.
UNKNOWN_LINES = 100_000


def counters(events: DataFrame) -> DataFrame:
    """(what, n) of the run's plain counters, from one pass."""
    row = S.summary_counts(events)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in row.columns])).alias("x")).select("x.*")


def partials(events: DataFrame) -> dict[str, DataFrame]:
    """All mergeable tables of a batch of complete files. ``events`` is read by each of them, so it should be a stored table."""
    ops, conns, sessions = stored(O.build_operations(events)), stored(O.build_connections(events)), O.session_correlations(events)
    done = O.completed(ops)
    times = done.agg(*[S.time_sum(c).alias(c) for c in ("etime", "qtime")])
    return {
        "counters": counters(events),
        "times": times.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("total")) for c in times.columns])).alias("x")).select("x.*"),
        "versions": events.where("kind = 'VERSION'").groupBy("file").agg(F.min_by(S.openldap_version(), "ord").alias("version")),
        "operation_counts": S.operation_counts(events),
        "texts": S.texts_by_code(ops),
        "accounts": S.account_stats(ops),
        "types": done.where("type is not null").groupBy("type").agg(S.time_sum("etime").alias("etime_total")),
        "servers": S.load_by_server(events, ops).drop("share"),
        "bases": S.base_stats(events, ops),
        "filters": S.filter_stats(events, ops),
        "filters_one_entry": S.filters_by_entries(ops, 1),
        "filters_no_entry": S.filters_by_entries(ops, 0),
        "wildcard_filters": S.wildcard_filters(events),
        "account_filters": S.with_filter_key(done).groupBy(F.col("who").alias("account"), "filter").agg(F.count("*").alias("n")),
        "attributes": S.attribute_counts(events),
        "qmark_filters": S.qmark_filters(events),
        "not_indexed": S.not_indexed(events),
        "extended_ops": S.extended_ops(events).select("oid", "name", "n"),
        "global_controls": S.global_controls(events),
        "csn_events": S.csn_events(events),
        "misc_counters": S.misc_counters(events),
        "server_logs": S.server_log_counts(events),
        "bind_usage": S.bind_usage(O.bind_usage_rows(events)),
        "mechanisms": S.sasl_mechanisms(events),
        "paged": S.paged_searches(O.paged_by_control(events), O.paged_by_shape(events, ops)),
        "families": P.filter_families(ops).drop("etime_avg"),
        "sequences": P.operation_sequences(ops),
        "hours": P.etime_by_hour(ops),
        "coverage": S.coverage_by_server(events),
        "latency": S.latency_histogram(ops),
        "density": S.latency_density(ops),
        "error_times": done.where(is_error(F.col("err")) & F.col("end_ts_ns").isNotNull()).groupBy(div(F.col("end_ts_ns"), NS).alias("t"), "err").agg(F.count("*").alias("n")),
        "lifecycle": L.server_events(events, events.where("kind = 'VERSION'").groupBy("file").agg(F.min_by(S.openldap_version(), "ord").alias("version"))),
        "connections_timeline": L.connection_events(events).select("t", "server", "file", "ord", "delta"),
        "top_operations": top_operations(ops),
        "top_connections": top_connections(conns),
        "slowest_operation": slowest_operation(done),
        "slowest_connection": slowest_connection(conns),
        "unknown_lines": TOPS["unknown_lines"](events.where(F.col("kind").isin(*UNKNOWN)).select("raw")),
        "correlations": sessions,
    }


def merge_table(name: str, parts: list[DataFrame]) -> DataFrame:
    """One table of several states; the order of the states does not matter."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if name in TOPS:
        return TOPS[name](rows)
    if name == "correlations":
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("first_ts_ns", c)))
        return rows.groupBy("server", "restart", "conn").agg(F.min("first_ts_ns").alias("first_ts_ns"), *[first(c).alias(c) for c in ("real_ip", "name", "username", "accept", "binddn")])
    keys, rules = RULES[name]
    if not rules:
        return rows
    how = {"sum": lambda c: F.sum(c), "money": lambda c: F.sum(F.col(c).cast(MONEY)).cast("double"), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
    return rows.groupBy(*keys).agg(*[how[r](c).alias(c) for c, r in rules.items()])


def merge_states(*states: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: merge_table(name, [s[name] for s in states]) for name in states[0]}


NAMES = (*RULES, *TOPS, "correlations")


def save_state(tables: dict[str, DataFrame], path: str, batch: str = "") -> None:
    """One Parquet table each under ``path``; last the version of the scheme and the name of the batch, which make it whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, batch)], "schema_version int, batch string").write.mode("overwrite").parquet(f"{path}/scheme")


def scheme(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(version, batch) of a saved state; None where there is no whole one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scheme/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return tuple(spark.read.parquet(f"{path}/scheme").first())


def load_state(spark: SparkSession, *paths: str) -> dict[str, DataFrame]:
    """The tables of one or more saved states, merged. A version that is not known, or a state that is not whole, is refused."""
    states = []
    for path in paths:
        found = scheme(spark, path)
        if found is None or found[0] != VERSION:
            raise ValueError(f"{path}: {'no whole state' if found is None else f'state of version {found[0]}'}, expected version {VERSION}")
        states.append({n: spark.read.parquet(f"{path}/{n}") for n in NAMES})
    return merge_states(*states) if len(states) > 1 else states[0]


def errors(state: dict[str, DataFrame]) -> DataFrame:
    """(who, err, text, n) of failing codes. What counts as failing is decided when read, so old states follow new lists."""
    return state["texts"].where(is_error(F.col("err")))


def refuse_foreign(events: DataFrame, state: dict[str, DataFrame]) -> None:
    """Raises where a batch names servers that the state does not know."""
    known = state["coverage"].select("server")
    found = [r.server for r in O.foreign_servers(events, known).limit(10).collect()]
    if found and known.where("server is not null").limit(1).count():
        raise ValueError(f"servers that the state does not know: {', '.join(sorted(found))}")
