"""Registered queries over logs that the events table is rendered to in every dialect, and the same results as SQL.

The cluster log has sessions, paged searches, restarts and all kinds of lines; the logs of the other servers tell the
same events in their own words. The SQL works on the events and never sees a log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlog import fixtures as X
from dirlog.functions.timestamps import NS, div, format_timestamp
from dirlog.operators import operations as O
from dirlog.operators import patterns as P
from dirlog.operators import stats as S
from dirlog.operators import timeline as L
from dirlog.plans import events as E
from dirlog.session import shared_dir, stored, tuned
from dirlog.sources import report, sinks
from dirlog.sources import state as St
from dirlog.sources.lines import classify_files, select_run_kind

Query = Callable[[SparkSession, str], DataFrame]
YEAR = 2024


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.parse_openldap(X.render_cluster(table(spark, sf_dir)), year=YEAR)


def on_cluster(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(cluster(spark, sf_dir))


def on_stored(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that read events more than once."""
    return lambda spark, sf_dir: f(stored(cluster(spark, sf_dir)))


def on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = stored(cluster(spark, sf_dir))
        return f(events, O.build_operations(events))

    return query


def lifecycle(events: DataFrame) -> DataFrame:
    return L.server_events(events, E.parse_version_banner(events))


def all_outages(events: DataFrame) -> DataFrame:
    end = events.agg(F.max("ts_ns").alias("end")).first().end
    return L.outages(lifecycle(events), end or 0)


def half_days(events: DataFrame) -> DataFrame:
    """Lines of the forenoons, each day as a server of its own: what a run with gaps covers."""
    hour = F.pmod(div(F.col("ts_ns"), 3600 * NS), F.lit(24))
    return events.where(hour < 12).withColumn("server", F.concat(F.lit("day"), div(F.col("ts_ns"), 86400 * NS).cast("string")))


def takeover(events: DataFrame) -> DataFrame:
    """The hours' leaders where one account has the first 300 hours and another the rest."""
    operations = O.build_operations(events)
    start = 1704067200 * NS
    who = F.when(F.col("end_ts_ns") < start + 300 * 3600 * NS, "early").otherwise("late")
    return P.onsets(P.top_consumer_per_hour(P.etime_by_hour(operations.withColumn("who", who))))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten files, of which two are none that is read."""
    e = table(spark, sf_dir)
    parts = [X.render_cluster(e), X.render_ds389(e), X.render_ds389(e, json=True), X.render_opendj(e), *[X.render_errors(e, d) for d in ("ds389", "json", "opendj")]]
    note = e.select(F.lit("note.txt").alias("file"), X.place(F.col("event_id"), F.lit(0)).alias("ord"), X.text("note ", F.col("event_id")).alias("raw"))
    audit = e.select(F.lit("audit.ldif").alias("file"), X.place(F.col("event_id"), F.lit(0)).alias("ord"), X.text("time: ", F.unix_seconds("ts")).alias("raw"))
    return E.united([*parts, note, audit])


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(mixed_lines(spark, sf_dir))


def parsed_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stored(mixed_lines(spark, sf_dir))
    events = E.parse_files(lines, stored(select_run_kind(classify_files(lines))), server="unnamed")
    return events.groupBy("file", "kind", "server").agg(F.count("*").alias("n"))


def written_logs(spark: SparkSession, sf_dir: str) -> str:
    """Log files in the shared folder, a quarter of the users each: plain, gzip, bzip2 under another ending, pretty JSON."""
    e, base = table(spark, sf_dir), f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    part = lambda n: e.where(F.col("user_id") % 4 == n)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(root)

    def write(name: str, lines: DataFrame, **options) -> None:
        order = ["conn", "ord"]
        conn = F.coalesce(F.regexp_extract("raw", r'conn(?:=|_id":)(\d+)', 1).try_cast("long"), F.lit(-1))
        rows = lines.withColumn("conn", conn).repartition("conn").sortWithinPartitions(*order)
        rows.select(F.col("raw").alias("value")).write.text(f"{base}/{name}", **options)

    write("plain", X.render_ds389(part(0)))
    write("gzip", X.render_opendj(part(1)), compression="gzip")
    write("hidden", X.render_ds389(part(2)), compression="bzip2")
    pretty = X.render_ds389(part(3), json=True).withColumn("raw", F.regexp_replace(F.regexp_replace("raw", r"^\{", "{\n  "), r"\}$", "\n}"))
    write("pretty", pretty.withColumn("raw", F.regexp_replace("raw", ',"', ',\n  "')))
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/hidden")):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), status.getPath().suffix("_2026-03-01"))
    return base


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = written_logs(spark, sf_dir)
    events = E.read_events(spark, base, recursive=True)
    folder = F.element_at(F.split("file", "/"), -2)
    return events.groupBy(folder.alias("folder"), "kind").agg(F.count("*").alias("n"))


def answered(ops: DataFrame) -> DataFrame:
    ops = ops.where("end_kind in ('RESULT', 'SEARCH_RESULT')")
    return ops.select("conn", "op", "type", "who", "base", "scope", "filter", "dn", "err", "nentries", F.round("etime", 6).alias("etime"), F.coalesce("not_indexed", F.lit(False)).alias("not_indexed"), "text", "start_ts_ns", "end_ts_ns")


def operations_of(lines: Callable[[DataFrame], DataFrame], parser: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return answered(O.build_operations(E.PARSERS[parser](lines(table(spark, sf_dir)))))

    return query


def layout_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a folder of JSON logs, read back: objects of many lines in three layouts, next to leftovers of an editor."""
    base = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    lines = X.render_ds389(table(spark, sf_dir), json=True)
    conn = F.coalesce(F.regexp_extract("raw", r'conn_id":(\d+)', 1).try_cast("long"), F.lit(-1))
    fields = F.regexp_replace(F.expr("substring(raw, 2, length(raw) - 2)"), ',"', ',\n  "')
    flush, indented, closing = (F.concat(F.lit(a), fields, F.lit(b)) for a, b in (("{\n  ", "\n}"), ("  {\n  ", "\n  }"), ("{\n  ", "}")))
    raw = F.when(F.col("conn") % 3 == 0, flush).when(F.col("conn") % 3 == 1, indented).otherwise(closing)
    rows = lines.withColumn("conn", conn).repartition("conn").sortWithinPartitions("conn", "ord").select(raw.alias("value"))
    rows.write.text(f"{base}/access", compression="gzip")
    spark.read.text(f"{base}/access").write.text(f"{base}/plain.bak")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/plain.bak")):
        fs.rename(status.getPath(), status.getPath().suffix(".bak"))
    return answered(O.build_operations(E.read_events(spark, base, recursive=True)))


def binds_of(lines: Callable[[DataFrame], DataFrame], parser: str) -> Query:
    return lambda spark, sf_dir: S.bind_usage(O.bind_usage_rows(E.PARSERS[parser](lines(table(spark, sf_dir)))))


def errors_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir)
    logs = (("ds389", "ds389-errors-text"), ("json", "ds389-errors-json"), ("opendj", "opendj-errors"))
    parts = [S.server_log_counts(events := E.PARSERS[parser](X.render_errors(e, d))).union(events.groupBy(F.lit("kind"), "kind").agg(F.count("*"))).withColumn("log", F.lit(d)) for d, parser in logs]
    return E.united(parts)


def two_states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The cluster's files f0 and f1, each brought to a state of its own, the first saved and loaded, then merged."""
    events = stored(cluster(spark, sf_dir))
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    wanted = ("counters", "times", "texts", "accounts", "types", "servers", "operation_counts", "coverage", "families", "hours", "paged", "latency", "bind_usage")
    halves = [{n: t for n, t in St.partials(events.where(F.col("file") == f)).items() if n in wanted} for f in ("f0", "f1")]
    St.save_state(halves[0], path)
    loaded = {n: spark.read.parquet(f"{path}/{n}") for n in wanted}
    return St.merge_states(loaded, halves[1])


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, failing results, servers and account figures of the merged state, as (table, key, n, etime)."""
    s = two_states(spark, sf_dir)
    none = F.lit(None).cast("double")
    row = lambda name, df, key, n, t=none: df.select(F.lit(name).alias("table"), key.alias("key"), n.cast("long").alias("n"), F.round(t, 6).alias("etime"))
    parts = [
        row("counters", s["counters"].where("what in ('lines', 'unknown_lines', 'connections_opened', 'connections_closed', 'starts', 'not_indexed_count', 'binds')"), F.col("what"), F.col("n")),
        row("errors", St.errors(s).groupBy("err", "text").agg(F.sum("n").alias("n")), F.concat_ws(" ", F.col("err").cast("string"), "text"), F.col("n")),
        row("accounts", s["accounts"], F.col("account"), F.col("ops"), F.col("etime_total")),
        row("servers", s["servers"], F.col("server"), F.col("connections"), F.col("etime_total")),
        row("types", s["types"], F.col("type"), F.lit(None), F.col("etime_total")),
    ]
    return E.united(parts)


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per type as the report has it."""
    tables = report.report_tables(St.partials(stored(cluster(spark, sf_dir))))
    return tables["cost_by_type"].select("type", "ops", "etime_total", F.round("avg_etime", 6).alias("avg_etime"), F.round("share", 3).alias("share"))


def header_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.parse_openldap(X.render_shapes(table(spark, sf_dir)), year=YEAR)
    return e.groupBy("format", "kind", "server").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.sum("conn").alias("conns"))


def time_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = (F.unix_micros("ts") * 1000).alias("ns")
    rows = table(spark, sf_dir).select("event_id", ns)
    return rows.select("event_id", *[format_timestamp(F.col("ns"), s).alias(s) for s in ("rfc3339", "iso8601", "minute", "syslog", "epoch")])


#: The facts: f one row an event, x one a line of the cluster log, o one an operation.
BASE = """
WITH f AS (SELECT event_id, ts, epoch_ns(ts) AS ns, user_id AS u, event_type AS t, CAST(value AS DECIMAL(18,2)) AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
        min(event_id) OVER (PARTITION BY user_id) = event_id AS first, max(event_id) OVER (PARTITION BY user_id) = event_id AS last,
        'uid=u' || user_id || ',ou=apps,dc=example,dc=com' AS dn, 'ldap' || (user_id % 3 + 1) AS server, 'f' || (user_id % 2) AS file FROM events),
y AS (SELECT *, CASE WHEN u % 4 < 2 THEN dn ELSE 'unknown' END AS who, t = 'error' AS e, t IN ('click', 'view') AS s, event_id + 1 AS op FROM f),
z AS (SELECT y.*, unnest([
    {p: -40, kind: 'SLAPD_STARTING', c: NULL, yes: event_id % 1000 = 0}, {p: -39, kind: 'VERSION', c: NULL, yes: event_id = 0},
    {p: -30, kind: 'DAEMON_SHUTDOWN', c: NULL, yes: event_id % 2000 = 600}, {p: -30, kind: 'SLAPD_STOPPED', c: NULL, yes: event_id % 2000 = 601},
    {p: -20, kind: 'ACCEPT', c: u, yes: first}, {p: -19, kind: 'STARTTLS', c: u, yes: first AND u % 5 = 1}, {p: -18, kind: 'TLS', c: u, yes: first AND u % 5 < 2},
    {p: -17, kind: CASE WHEN u % 4 = 3 THEN 'BIND_ANON' ELSE 'BIND' END, c: u, yes: first}, {p: -16, kind: 'BIND_DN_INFO', c: u, yes: first AND u % 4 = 1}, {p: -15, kind: 'RESULT', c: u, yes: first},
    {p: -2, kind: 'GET_CTRLS', c: NULL, yes: t = 'click' AND k % 4 = 1}, {p: -2, kind: 'NOT_INDEXED', c: NULL, yes: t = 'view' AND k % 10 = 0},
    {p: 0, kind: 'SRCH', c: u, yes: s}, {p: 1, kind: 'SRCH_ATTR', c: u, yes: t = 'click'}, {p: 2, kind: 'SEARCH_RESULT', c: u, yes: s},
    {p: 0, kind: ['CMP', 'DEL', 'MODRDN', 'EXT', 'ABANDON'][k % 5 + 1], c: u, yes: e}, {p: 2, kind: 'RESULT', c: u, yes: e AND k % 5 < 4},
    {p: -1, kind: ['CSN_GET', 'CSN_QUEUE', 'CSN_GRADUATE'][k % 3 + 1], c: CASE WHEN k % 3 = 0 THEN u END, yes: t = 'purchase'},
    {p: 0, kind: 'MOD', c: u, yes: t = 'purchase'}, {p: 1, kind: 'MOD', c: u, yes: t = 'purchase'}, {p: 2, kind: 'RESULT', c: u, yes: t = 'purchase'},
    {p: 0, kind: 'ADD', c: u, yes: t = 'signup'}, {p: 2, kind: 'RESULT', c: u, yes: t = 'signup' AND k % 5 > 0},
    {p: 5, kind: ['CONN_DEFER', 'CONTROL_NOT_SUPPORTED', 'GLOBAL_CONTROL', 'UNKNOWN_LINE'][k - 6], c: CASE WHEN k = 7 THEN u END, yes: k BETWEEN 7 AND 10},
    {p: 10, kind: 'SRCH', c: u, yes: last}, {p: 11, kind: 'SEARCH_RESULT', c: u, yes: last}, {p: 12, kind: 'SRCH', c: u, yes: last}, {p: 13, kind: 'SEARCH_RESULT', c: u, yes: last}, {p: 14, kind: 'SRCH', c: u, yes: last},
    {p: 15, kind: 'SEARCH_RESULT', c: u, yes: last}, {p: 20, kind: 'UNBIND', c: u, yes: last}, {p: 21, kind: 'CLOSED', c: u, yes: last}], recursive := true) FROM y),
x AS (SELECT * FROM z WHERE yes),
o AS (SELECT u AS conn, op, CASE t WHEN 'purchase' THEN 'MOD' WHEN 'signup' THEN 'ADD' WHEN 'error' THEN ['CMP', 'DEL', 'MODRDN', 'EXT', 'ABANDON'][k % 5 + 1] ELSE 'SRCH' END AS type, who, server, v, ns,
        CASE WHEN e THEN [6, 32, 68, 0][k % 5 + 1] WHEN t = 'signup' THEN [50, 3, 80][k % 3 + 1] ELSE 0 END AS err,
        CASE WHEN e THEN [NULL, 'gone', 'there', NULL][k % 5 + 1] WHEN t = 'signup' THEN 'no ' || (k % 2) END AS txt, NOT (t = 'signup' AND k % 5 = 0) AS ended, e AND k % 5 = 4 AS dropped FROM y
    UNION ALL SELECT u, 0, 'BIND', who, server, 0, ns, 0, NULL, true, false FROM y WHERE first
    UNION ALL SELECT u, 900000000, 'STARTTLS', 'unknown', server, NULL, ns, NULL, NULL, false, false FROM y WHERE first AND u % 5 = 1
    UNION ALL SELECT u, 900000000 + n, 'SRCH', who, server, 0, ns, 0, NULL, true, false FROM y, (VALUES (10), (11), (12)) p(n) WHERE last),
r AS (SELECT * FROM o WHERE ended AND NOT dropped),
starts AS (SELECT file, event_id AS begun FROM x WHERE kind = 'SLAPD_STARTING'),
tracked AS (SELECT y.*, (SELECT count(*) FROM starts WHERE starts.file = y.file AND begun <= y.event_id) AS restart, '198.51.100.' || (u % 50) AS ip, 'app' || (u % 7) || ' pid=' || k AS name, 'user' || (u % 11) AS username,
        '203.0.113.' || (u % 200) || ':' || (u + 1024) AS accept FROM y WHERE t = 'click' AND k % 4 = 0 AND u % 4 < 2),
correlations AS (SELECT server, restart, u AS conn, min(ns) AS first_ts_ns, min(ip) AS real_ip, arg_min(name, event_id) AS name, min(username) AS username, min(accept) AS accept, min(dn) AS binddn FROM tracked GROUP BY server, restart, u),
life AS (SELECT ns, ns // 1000000000 AS sec, CASE WHEN event_id % 1000 = 0 THEN 'start' WHEN event_id % 2000 = 600 THEN 'shutdown' ELSE 'stop' END AS what, file, server, event_id FROM y WHERE event_id % 1000 = 0 OR event_id % 2000 IN (600, 601)),
ordered AS (SELECT *, lag(what) OVER (ORDER BY sec, event_id) AS before FROM life),
edges AS (SELECT *, lead(sec) OVER (ORDER BY sec, event_id) AS up FROM ordered WHERE (what = 'start' AND before <> 'start') OR (what <> 'start' AND coalesce(before, 'start') = 'start')),
outages AS (SELECT sec AS a, coalesce(up, (SELECT max(ns) // 1000000000 FROM f)) AS b FROM edges WHERE what <> 'start' AND coalesce(up, (SELECT max(ns) // 1000000000 FROM f)) > sec)
"""
TIME = "CAST(sum(v) AS DOUBLE)"
CODES = """, codes(code, name, class) AS (VALUES (0, 'success', 'informational'), (6, 'compareTrue', 'informational'), (32, 'noSuchObject', 'client'), (68, 'entryAlreadyExists', 'client'), (50, 'insufficientAccessRights', 'policy-or-client'),
        (3, 'timeLimitExceeded', 'policy'), (80, 'other', 'server'))"""
PAGES = "SELECT who, count(*) AS pages FROM y WHERE t = 'click' AND k % 4 = 1 GROUP BY who"
SHAPES = "SELECT who, CAST(3 * count(*) AS BIGINT) AS pages FROM y WHERE last GROUP BY who"
#: What the other servers' logs tell of an event: d one row an operation that ended.
OTHERS = """
WITH y AS (SELECT event_id, epoch_ns(ts) AS ns, user_id AS u, event_type AS t, CAST(value AS DECIMAL(18,2)) AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
        min(event_id) OVER (PARTITION BY user_id) = event_id AS first, max(event_id) OVER (PARTITION BY user_id) = event_id AS last, 'uid=u' || user_id || ',ou=apps,dc=example,dc=com' AS account,
        event_type IN ('click', 'view') AS s FROM events)
"""
DS389 = OTHERS + """, d AS (SELECT u AS conn, event_id + 1 AS op, CASE WHEN s THEN 'SRCH' WHEN t = 'error' THEN 'CMP' WHEN t = 'purchase' THEN 'MOD' ELSE 'ADD' END AS type, account AS who,
        CASE t WHEN 'click' THEN 'ou=people,dc=example,dc=com' WHEN 'view' THEN 'ou=groups,dc=example,dc=com' END AS base, CASE t WHEN 'click' THEN 2 WHEN 'view' THEN 1 END AS scope,
        CASE t WHEN 'click' THEN '(uid=u' || k || ')' WHEN 'view' THEN '(cn=*g' || k || '*)' END AS filter, CASE WHEN NOT s THEN 'uid=u' || k || ',ou=people,dc=example,dc=com' END AS dn,
        CASE WHEN t = 'error' THEN 32 ELSE 0 END AS err, k AS nentries, CAST(v AS DOUBLE) AS etime, t = 'view' AND k % 10 = 0 AS not_indexed, CAST(NULL AS VARCHAR) AS text, ns AS start_ts_ns, ns AS end_ts_ns FROM y
    UNION ALL SELECT u, 0, 'BIND', account, NULL, NULL, NULL, account, 0, 0, 0, false, NULL, ns, ns FROM y WHERE first) SELECT * FROM d"""
OPENDJ = OTHERS + """, d AS (SELECT u AS conn, event_id + 1 AS op, CASE WHEN s THEN 'SRCH' WHEN t = 'error' THEN 'CMP' WHEN t = 'purchase' THEN 'MOD' ELSE 'ADD' END AS type, account AS who,
        CASE WHEN s THEN 'ou=people,dc=example,dc=com' END AS base, CASE t WHEN 'click' THEN 2 WHEN 'view' THEN 1 END AS scope, CASE WHEN s THEN '(uid=u' || k || ')' END AS filter,
        CASE WHEN NOT s THEN 'uid=u' || k || ',ou=people,dc=example,dc=com' END AS dn, CASE WHEN t = 'error' THEN 32 ELSE 0 END AS err, CASE WHEN s THEN k END AS nentries, CAST(v AS DOUBLE) AS etime, false AS not_indexed,
        CASE WHEN t = 'error' THEN 'no such thing etime=5' END AS text, ns // 1000000000 * 1000000000 AS start_ts_ns, ns // 1000000000 * 1000000000 AS end_ts_ns FROM y
    UNION ALL SELECT u, 0, 'BIND', account, NULL, NULL, NULL, account, 0, NULL, 0, false, NULL, ns // 1000000000 * 1000000000, ns // 1000000000 * 1000000000 FROM y WHERE first
    UNION ALL SELECT u, 900000001, 'EXT', 'unknown', NULL, NULL, NULL, NULL, 0, NULL, 0, false, NULL, ns // 1000000000 * 1000000000, ns // 1000000000 * 1000000000 FROM y WHERE first AND u % 5 = 1) SELECT * FROM d"""
#: Lines of the other servers' access logs by kind; {0} says which users.
DS389_KINDS = """SELECT unnest([{{kind: 'ACCEPT', yes: first}}, {{kind: 'BIND', yes: first}}, {{kind: 'RESULT', yes: first}}, {{kind: CASE WHEN s THEN 'SRCH' WHEN t = 'error' THEN 'CMP' WHEN t = 'purchase' THEN 'MOD' ELSE 'ADD' END, yes: true}},
    {{kind: CASE WHEN s THEN 'SEARCH_RESULT' ELSE 'RESULT' END, yes: true}}, {{kind: 'SRCH', yes: k = 5 AND {1}}}, {{kind: 'UNBIND', yes: last}}, {{kind: 'CLOSED', yes: last}}, {{kind: 'TITLE', yes: event_id = 0 AND {1}}}], recursive := true) FROM y WHERE {0}"""
OPENDJ_KINDS = """SELECT unnest([{{kind: 'ACCEPT', yes: first}}, {{kind: 'EXT', yes: first AND u % 5 = 1}}, {{kind: 'RESULT', yes: first AND u % 5 = 1}}, {{kind: 'BIND', yes: first}}, {{kind: 'RESULT', yes: first}}, {{kind: CASE WHEN s THEN 'SRCH' WHEN t = 'error' THEN 'CMP' WHEN t = 'purchase' THEN 'MOD' ELSE 'ADD' END, yes: true}},
    {{kind: CASE WHEN s THEN 'SEARCH_RESULT' ELSE 'RESULT' END, yes: true}}, {{kind: 'UNBIND', yes: last}}, {{kind: 'CLOSED', yes: last}}], recursive := true) FROM y WHERE {0}"""
LEVEL = "CASE WHEN t = 'signup' THEN 'NOTICE' WHEN k % 2 = 0 THEN 'ERR' ELSE 'WARNING' END"
BINDS = OTHERS + "SELECT what, name, count(*) AS n FROM (SELECT 'method' AS what, CASE WHEN u % 4 = 1 THEN 'SASL' ELSE 'SIMPLE' END AS name FROM y WHERE first UNION ALL SELECT 'transport', {} FROM y WHERE first {}) GROUP BY what, name"
FILES = "(VALUES ('f0', 'openldap'), ('f1', 'openldap'), ('ds389.log', 'ds389-text'), ('ds389.json', 'ds389-json'), ('opendj.log', 'opendj'), ('errors.ds389', 'ds389-errors-text'), ('errors.json', 'ds389-errors-json'), ('errors.opendj', 'opendj-errors'), ('note.txt', 'not-a-log'), ('audit.ldif', 'ds389-other'))"
#: Only files that the table gives lines to.
THERE = f"SELECT v.file, v.kind FROM {FILES} v(file, kind) WHERE EXISTS (SELECT 1 FROM y WHERE v.file = 'f' || (u % 2)) OR (v.file NOT LIKE 'f_' AND EXISTS (SELECT 1 FROM y WHERE v.file NOT LIKE 'errors.%' OR t IN ('error', 'signup')))"
REASON = "CASE kind WHEN 'not-a-log' THEN 'not a log' WHEN 'ds389-other' THEN 'audit or security stream' END"
STAMP = "strftime(make_timestamp_ns({ns}), '%Y-%m-%dT%H:%M:%S.%n') || 'Z'"


def counted(kinds: str, name: str, what: str = "file") -> str:
    return f"SELECT '{name}' AS {what}, kind, count(*) AS n FROM ({kinds}) WHERE yes GROUP BY kind"


ERROR_KINDS = "SELECT '{0}' AS log, 'kind' AS what, 'SERVER_LOG' AS name, count(*) AS n FROM y WHERE t IN ('error', 'signup') UNION ALL SELECT '{0}', 'severity', " + LEVEL + ", count(*) FROM y WHERE t IN ('error', 'signup') GROUP BY 3 UNION ALL SELECT '{0}', 'subsystem', 'part' || (k % 5), count(*) FROM y WHERE t IN ('error', 'signup') GROUP BY 3"
MORE_LINES = " UNION ALL SELECT '{0}', 'kind', 'SERVER_LOG_CONT', count(*) FROM y WHERE t IN ('error', 'signup') AND k % 10 = 0 HAVING count(*) > 0"
ALL_ERRORS = " UNION ALL ".join(ERROR_KINDS.format(d) + (MORE_LINES.format(d) if d != "json" else "") for d in ("ds389", "json", "opendj"))

#: Name, query, and SQL.
REGISTERED: list[tuple[str, Query, str]] = [
    ("line_kinds", on_cluster(lambda e: e.groupBy("file", "kind", "conn").agg(F.count("*").alias("n"))), f"{BASE} SELECT file, kind, c AS conn, count(*) AS n FROM x GROUP BY file, kind, c"),
    ("inflight_operations", on_cluster(lambda e: O.inflight_operations(O.build_operations(e)).select("conn", "op", "type", "who")), f"{BASE} SELECT conn, op, type, who FROM o WHERE NOT ended"),
    ("bind_usage_rows", on_cluster(lambda e: O.bind_usage_rows(e).select("file", "server", "conn", "op", "method", "transport", "session_control")), f"""{BASE} SELECT file, server, u AS conn, CAST(0 AS BIGINT) AS op, CASE WHEN u % 4 < 2 THEN 'SIMPLE' ELSE 'ANONYMOUS' END AS method,
        CASE u % 5 WHEN 0 THEN 'ldaps' WHEN 1 THEN 'ldap + StartTLS' ELSE 'ldap' END AS transport, false AS session_control FROM y WHERE first"""),
    ("bind_transports", on_cluster(lambda e: S.bind_usage(O.bind_usage_rows(e))), f"""{BASE} SELECT what, name, count(*) AS n FROM (SELECT 'method' AS what, CASE WHEN u % 4 < 2 THEN 'SIMPLE' ELSE 'ANONYMOUS' END AS name FROM y WHERE first
        UNION ALL SELECT 'transport', CASE u % 5 WHEN 0 THEN 'ldaps' WHEN 1 THEN 'ldap + StartTLS' ELSE 'ldap' END FROM y WHERE first) GROUP BY what, name"""),
    ("sasl_mechanisms", on_cluster(S.sasl_mechanisms), f"{BASE} SELECT 'SCRAM-SHA-256' AS mech, count(*) AS n FROM y WHERE first AND u % 4 = 1 HAVING count(*) > 0"),
    ("restart_epoch", on_stored(lambda e: O.restart_epoch(e).groupBy("file", "restart").agg(F.count("*").alias("n"))), f"""{BASE} SELECT file, CAST(restart AS INTEGER) AS restart, count(*) AS n FROM (SELECT file,
        (SELECT count(*) FROM starts WHERE starts.file = x.file AND (begun < event_id OR (begun = event_id AND p > -40))) AS restart FROM x) GROUP BY file, restart"""),
    ("session_correlations", on_stored(O.session_correlations), f"{BASE} SELECT server, CAST(restart AS INTEGER) AS restart, conn, first_ts_ns, real_ip, name, username, accept, binddn FROM correlations"),
    ("distinct_correlations", on_stored(lambda e: O.distinct_correlations(O.session_correlations(e)).drop("restart")), f"{BASE} SELECT accept, real_ip, name, username, binddn, min(first_ts_ns) AS first_ts_ns, arg_min(server, first_ts_ns) AS server, arg_min(conn, first_ts_ns) AS conn FROM correlations GROUP BY accept, real_ip, name, username, binddn"),
    ("session_groups", on_stored(lambda e: S.session_groups(O.session_correlations(e))), f"{BASE} SELECT regexp_replace(name, ' .*', '') AS name, real_ip, username, binddn, count(*) AS sessions, count(DISTINCT regexp_replace(accept, ':.*', '')) AS nat_hosts FROM correlations GROUP BY 1, 2, 3, 4"),
    ("paged_by_control", on_stored(O.paged_by_control), f"{BASE} {PAGES}"),
    ("paged_by_shape", on_both(O.paged_by_shape), f"{BASE} {SHAPES}"),
    ("paged_searches", on_both(lambda e, o: S.paged_searches(O.paged_by_control(e), O.paged_by_shape(e, o))), f"{BASE} SELECT who AS account, CAST(sum(pages) AS BIGINT) AS pages FROM ({PAGES} UNION ALL {SHAPES}) GROUP BY who"),
    ("foreign_servers", on_stored(lambda e: O.foreign_servers(e, e.where("conn % 3 = 0"))), f"{BASE} SELECT DISTINCT server FROM x EXCEPT SELECT DISTINCT server FROM x WHERE c % 3 = 0"),
    ("server_events", on_stored(lambda e: lifecycle(e).select("file", "server", "ts_ns", "what", "label")), f"{BASE} SELECT file, server, ns AS ts_ns, what, what || CASE WHEN what = 'start' AND file = (SELECT file FROM y WHERE event_id = 0) THEN ' (OpenLDAP 2.6.7)' ELSE '' END AS label FROM life"),
    ("outages", on_stored(all_outages), f"{BASE} SELECT a * 1000000000 AS down_ns, b * 1000000000 AS up_ns FROM outages"),
    ("corroborated_outages", on_stored(lambda e: L.corroborated_outages(all_outages(e.where("ts_ns > 0")), e.where("conn % 10 = 3"))), f"{BASE} SELECT a * 1000000000 AS down_ns, b * 1000000000 AS up_ns FROM outages WHERE NOT EXISTS (SELECT 1 FROM x WHERE kind IN ('ACCEPT', 'CLOSED') AND c % 10 = 3 AND ns // 1000000000 > a AND ns // 1000000000 < b)"),
    ("abrupt_restarts", on_stored(lambda e: L.abrupt_restarts(lifecycle(e))), f"{BASE} SELECT file, server, ns AS ts_ns FROM ordered WHERE what = 'start' AND before = 'start'"),
    ("uncovered_spans", on_cluster(lambda e: L.uncovered_spans(S.coverage_by_server(half_days(e)))), f"""{BASE}, c AS (SELECT ns // 86400000000000 AS d, min(ns) AS a, max(ns) AS b FROM x WHERE ns // 3600000000000 % 24 < 12 GROUP BY 1),
        g AS (SELECT a, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM c) SELECT reached AS from_ns, a AS to_ns FROM g WHERE a > reached"""),
    ("onsets", on_cluster(takeover), f"{BASE} SELECT 'late' AS account, min(ns // 3600000000000) AS hour, round(20 / 24, 6) AS gain FROM r WHERE ns >= CAST(1704067200 + 300 * 3600 AS BIGINT) * 1000000000"),
    ("attribute_counts", on_cluster(S.attribute_counts), f"{BASE} SELECT attr, count(*) AS n FROM (SELECT unnest(CASE kind WHEN 'SRCH_ATTR' THEN ['cn', 'mail'] ELSE ['mail', 'phone'] END) AS attr FROM x WHERE kind = 'SRCH_ATTR' OR (kind = 'MOD' AND p = 1)) GROUP BY attr"),
    ("extended_ops", on_cluster(S.extended_ops), f"{BASE}, m(i, oid, name) AS (VALUES (3, '1.3.6.1.1.8', 'Cancel')) SELECT oid, name, count(*) AS n FROM x JOIN m ON k % 5 = i WHERE kind = 'EXT' GROUP BY oid, name"),
    ("global_controls", on_cluster(S.global_controls), f"{BASE} SELECT CASE kind WHEN 'GET_CTRLS' THEN '1.2.840.113556.1.4.319' ELSE '1.2.3.9' END AS oid, count(*) AS n FROM x WHERE kind IN ('GET_CTRLS', 'GLOBAL_CONTROL') GROUP BY 1"),
    ("qmark_filters", on_cluster(S.qmark_filters), f"{BASE} SELECT 'group=g' || k AS attr, count(*) AS n FROM y WHERE t = 'view' GROUP BY 1"),
    ("csn_events", on_cluster(S.csn_events), f"{BASE} SELECT kind, count(*) AS n FROM x WHERE kind LIKE 'CSN%' GROUP BY kind"),
    ("misc_counters", on_cluster(S.misc_counters), f"{BASE} SELECT CASE kind WHEN 'CONN_DEFER' THEN 'deferred operation' ELSE 'control not supported' END AS what, count(*) AS n FROM x WHERE kind IN ('CONN_DEFER', 'CONTROL_NOT_SUPPORTED') GROUP BY 1"),
    ("not_indexed", on_cluster(S.not_indexed), f"{BASE} SELECT 'cn' AS attr, count(*) AS n FROM x WHERE kind = 'NOT_INDEXED' HAVING count(*) > 0"),
    ("unknown_lines", on_cluster(lambda e: sinks.unknown_lines(e).select(F.regexp_extract("raw", ": (.*)$", 1).alias("said")).groupBy("said").agg(F.count("*").alias("n"))), f"{BASE} SELECT 'what is this ' || (u % 3) AS said, count(*) AS n FROM y WHERE k = 10 GROUP BY 1"),
    ("version_banner", on_cluster(E.parse_version_banner), f"{BASE} SELECT file, '2.6.7' AS version FROM y WHERE event_id = 0"),
    ("codes_of_all_classes", on_cluster(lambda e: S.texts_by_code(O.build_operations(e)).groupBy("err", "text").agg(F.sum("n").alias("n")).select("err", S.codes.result_code_name(F.col("err")).alias("name"), S.codes.result_code_class(F.col("err")).alias("class"), "text", "n")), f"{BASE} {CODES} SELECT err, name, class, txt AS text, count(*) AS n FROM r JOIN codes ON err = code GROUP BY ALL"),
    ("cluster_replay", on_cluster(lambda e: sinks.replay_table(O.build_operations(e)).select("conn", "op", "type", "who", "err", "etime", "text").where("op <> 900000009")), f"{BASE} SELECT conn, op, type, who, CASE WHEN ended AND NOT dropped THEN err END AS err, CASE WHEN ended AND NOT dropped THEN CAST(v AS DOUBLE) END AS etime, CASE WHEN ended AND NOT dropped THEN txt END AS text FROM o"),
    ("header_shapes", header_shapes, f"""{OTHERS}, h AS (SELECT ['debug', 'ol26', 'rfc3339', 'syslog', 'rfc3339-utc'][event_id % 5 + 1] AS format, [NULL, NULL, 'east', 'plain', 'west'][event_id % 5 + 1] AS server, CASE event_id % 5 WHEN 3 THEN ns // 1000000000 * 1000000000 ELSE ns END AS ns, u FROM y)
        SELECT format, 'UNBIND' AS kind, server, count(*) AS n, min(ns) AS first_ns, max(ns) AS last_ns, CAST(sum(u) AS BIGINT) AS conns FROM h GROUP BY format, server"""),
    ("time_styles", time_styles, f"""SELECT event_id, {STAMP.format(ns='epoch_ns(ts)')} AS rfc3339, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso8601, strftime(ts, '%Y-%m-%d %H:%M') AS minute,
        strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') AS syslog, CAST(epoch_ns(ts) // 1000000000 AS VARCHAR) || '.' || lpad(CAST(epoch_ns(ts) % 1000000000 AS VARCHAR), 9, '0') AS epoch FROM events"""),
    ("classify_files", files_of, f"{OTHERS} {THERE}"),
    ("select_run_kind", lambda spark, d: select_run_kind(files_of(spark, d)), f"{OTHERS} SELECT file, kind, {REASON} IS NULL AS kept, {REASON} AS reason FROM ({THERE})"),
    ("select_single_kind", lambda spark, d: select_run_kind(files_of(spark, d), single_kind=True), f"""{OTHERS}, w AS ({THERE}), g AS (SELECT *, coalesce({REASON}, CASE WHEN kind <> (SELECT arg_min(kind, file) FROM w WHERE {REASON} IS NULL) THEN 'another kind than the run''s' END) AS reason FROM w)
        SELECT file, kind, reason IS NULL AS kept, reason FROM g"""),
    ("parse_files", parsed_mix, f"""{BASE}, lines AS (SELECT file, kind, server, count(*) AS n FROM x WHERE kind <> 'UNKNOWN_LINE' OR true GROUP BY file, kind, server
        UNION ALL SELECT file, kind, 'unnamed', n FROM ({counted(DS389_KINDS.format('true', 'true'), 'ds389.log')} UNION ALL {counted(DS389_KINDS.format('true', 'false'), 'ds389.json')} UNION ALL {counted(OPENDJ_KINDS.format('true'), 'opendj.log')}
        UNION ALL SELECT 'errors.' || log, name, n FROM ({ALL_ERRORS}) WHERE what = 'kind' AND n > 0)) SELECT * FROM lines"""),
    ("read_events", parsed_files, f"""{OTHERS} {counted(DS389_KINDS.format('u % 4 = 0', 'true'), 'plain', 'folder')} UNION ALL {counted(OPENDJ_KINDS.format('u % 4 = 1'), 'gzip', 'folder')} UNION ALL {counted(DS389_KINDS.format('u % 4 = 2', 'true'), 'hidden', 'folder')}
        UNION ALL {counted(DS389_KINDS.format('u % 4 = 3', 'false'), 'pretty', 'folder')}"""),
    ("ds389_operations", operations_of(X.render_ds389, "ds389-text"), DS389),
    ("json_layout_operations", layout_operations, DS389),
    ("ds389_json_operations", operations_of(lambda e: X.render_ds389(e, json=True), "ds389-json"), DS389),
    ("opendj_operations", operations_of(X.render_opendj, "opendj"), OPENDJ),
    ("ds389_binds", binds_of(X.render_ds389, "ds389-text"), BINDS.format("'ldap'", "UNION ALL SELECT 'mechanism', 'GSSAPI' FROM y WHERE first AND u % 4 = 1")),
    ("opendj_binds", binds_of(X.render_opendj, "opendj"), BINDS.format("CASE u % 5 WHEN 0 THEN 'ldaps' WHEN 1 THEN 'ldap + StartTLS' ELSE 'ldap' END", "")),
    ("server_log_counts", errors_of_all, f"{OTHERS} SELECT * FROM ({ALL_ERRORS}) WHERE n > 0"),
    ("merged_state", state_rows, f"""{BASE} SELECT 'counters' AS "table", what AS key, n, CAST(NULL AS DOUBLE) AS etime FROM (SELECT unnest([{{what: 'lines', n: count(*)}}, {{what: 'unknown_lines', n: count(*) FILTER (kind = 'UNKNOWN_LINE')}}, {{what: 'connections_opened', n: count(*) FILTER (kind = 'ACCEPT')}},
            {{what: 'connections_closed', n: count(*) FILTER (kind = 'CLOSED')}}, {{what: 'starts', n: count(*) FILTER (kind = 'SLAPD_STARTING')}}, {{what: 'not_indexed_count', n: count(*) FILTER (kind = 'NOT_INDEXED')}}, {{what: 'binds', n: count(*) FILTER (kind IN ('BIND', 'BIND_ANON'))}}], recursive := true) FROM x)
        UNION ALL SELECT 'errors', err || coalesce(' ' || txt, ''), count(*), NULL FROM r WHERE err NOT IN (0, 6) GROUP BY err, txt UNION ALL SELECT 'accounts', who, count(*), round({TIME}, 6) FROM r GROUP BY who
        UNION ALL SELECT 'servers', server, count(*) FILTER (type = 'BIND'), round({TIME}, 6) FROM r GROUP BY server UNION ALL SELECT 'types', type, NULL, round({TIME}, 6) FROM r GROUP BY type"""),
    ("report_cost_by_type", report_rows, f"""{BASE}, l AS (SELECT CASE WHEN kind = 'BIND_ANON' THEN 'BIND ANONYMOUS' WHEN kind = 'BIND_DN_INFO' THEN 'BIND DN' ELSE kind END AS label, count(*) AS n FROM x GROUP BY 1)
        SELECT type, coalesce(any_value(n), 0) AS ops, {TIME} AS etime_total, round(CASE WHEN any_value(n) > 0 THEN {TIME} / any_value(n) ELSE 0 END, 6) AS avg_etime, round(100 * round({TIME} / (SELECT {TIME} FROM r), 6), 3) AS share FROM r LEFT JOIN l ON label = type GROUP BY type"""),
]
