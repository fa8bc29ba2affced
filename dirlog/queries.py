"""Registered queries of the log operators, and the same results from the events table as SQL.

Each query renders the events table as an OpenLDAP log, parses it, rebuilds operations and connections from
the lines and applies one operator. The SQL works on the events directly and never sees a log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlog import cluster_queries as C
from dirlog.fixtures import event_of, phase_of, render_openldap
from dirlog.operators import operations as O
from dirlog.operators import patterns as P
from dirlog.operators import ranking as K
from dirlog.operators import stats as S
from dirlog.operators import timeline as L
from dirlog.plans.events import parse_openldap
from dirlog.session import stored, tuned
from dirlog.sources import sinks
from dirlog.sources import state as St

Query = Callable[[SparkSession, str], DataFrame]
YEAR = 2024


def log_events(spark: SparkSession, sf_dir: str, header: str = "rfc3339-utc") -> DataFrame:
    """Parsed lines of the rendered events table."""
    events = tuned(spark).read.parquet(f"{sf_dir}/events.parquet")
    return parse_openldap(render_openldap(events, header), header, YEAR)


def on_events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(log_events(spark, sf_dir))


def on_stored(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For operators that read events more than once."""
    return lambda spark, sf_dir: f(stored(log_events(spark, sf_dir)))


def on_operations(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(O.build_operations(log_events(spark, sf_dir)))


def on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = stored(log_events(spark, sf_dir))
        return f(events, O.build_operations(events))

    return query


def on_connections(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(O.build_connections(log_events(spark, sf_dir)))


def merged_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs, one of even and one of odd users, each brought to partial tables, then merged."""
    events = tuned(spark).read.parquet(f"{sf_dir}/events.parquet")
    parts = []
    for parity in (0, 1):
        lines = render_openldap(events.where(F.col("user_id") % 2 == parity)).withColumn("file", F.lit(f"part{parity}"))
        parts.append(S.account_stats(O.build_operations(parse_openldap(lines, "rfc3339-utc", YEAR))))
    return St.merge_table("accounts", parts)


def syslog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with year-less headers."""
    events = log_events(spark, sf_dir, "syslog")
    return events.groupBy("kind", "server").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def split_order(rows: DataFrame) -> DataFrame:
    return rows.select("t", event_of(F.col("ord")).alias("event_id"), phase_of(F.col("ord")).alias("phase"), "delta", F.col("open").cast("bigint").alias("open"))


#: The facts of the rendered log: e one row an event, u one a user, ops one a completed operation.
BASE = """
WITH e AS (SELECT event_id, ts, epoch_ns(ts) AS ns, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
        'uid=u' || user_id || ',ou=apps,dc=example,dc=com' AS account, 'ldap' || (user_id % 3 + 1) AS server FROM events),
u AS (SELECT user_id, any_value(account) AS account, any_value(server) AS server, min(event_id) AS first_id, max(event_id) AS last_id, min(ns) AS first_ns, max(ns) AS last_ns,
        count(*) AS n, sum(v) AS v FROM e GROUP BY user_id),
ops AS (SELECT user_id AS conn, event_id + 1 AS op, account, server, ns, v, event_id, k,
        CASE event_type WHEN 'purchase' THEN 'MOD' WHEN 'signup' THEN 'ADD' ELSE 'SRCH' END AS type,
        CASE event_type WHEN 'click' THEN 'ou=people,dc=example,dc=com' WHEN 'view' THEN 'ou=groups,dc=example,dc=com' WHEN 'error' THEN 'cn=config' END AS base,
        CASE event_type WHEN 'click' THEN '(uid=u' || k || ')' WHEN 'view' THEN '(cn=*g' || k || '*)' WHEN 'error' THEN '(employeenumber=' || k || '*)' END AS filter,
        CASE event_type WHEN 'click' THEN '(uid=$#)' WHEN 'view' THEN '(cn=*$#*)' WHEN 'error' THEN '(employeenumber=#*)' END AS template,
        CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 0 END AS scope,
        CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k WHEN 'error' THEN 0 END AS nentries,
        CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 32 WHEN 1 THEN 49 WHEN 2 THEN 50 ELSE 53 END ELSE 0 END AS err FROM e
    UNION ALL SELECT user_id, 0, account, server, first_ns, 0, NULL, NULL, 'BIND', NULL, NULL, NULL, NULL, NULL, 0 FROM u),
codes(code, name, class) AS (VALUES (0, 'success', 'informational'), (32, 'noSuchObject', 'client'), (49, 'invalidCredentials', 'client'),
        (50, 'insufficientAccessRights', 'policy-or-client'), (53, 'unwillingToPerform', 'policy-or-client'))
"""
TIME = "CAST(sum(v) AS DOUBLE)"
LINES = """
, labels AS (SELECT type AS label, count(*) AS n FROM ops GROUP BY 1
    UNION ALL SELECT CASE WHEN type = 'SRCH' THEN 'SEARCH RESULT' ELSE 'RESULT' END, count(*) FROM ops GROUP BY 1
    UNION ALL SELECT x, count(*) FROM u, (VALUES ('ACCEPT'), ('CLOSED'), ('UNBIND')) t(x) GROUP BY 1)
"""
DELTAS = """
, deltas AS (SELECT CAST(floor(first_ns / 1e9) AS BIGINT) AS t, first_id AS event_id, -3 AS phase, 1 AS delta FROM u
    UNION ALL SELECT CAST(floor(last_ns / 1e9) AS BIGINT), last_id, 3, -1 FROM u),
sums AS (SELECT *, sum(delta) OVER (ORDER BY t, event_id, phase) AS s FROM deltas),
opened AS (SELECT t, event_id, phase, delta, CAST(s - least(0, min(s) OVER (ORDER BY t, event_id, phase)) AS BIGINT) AS open FROM sums),
w AS (SELECT CAST(floor(min(ns) / 1e9) AS BIGINT) AS t0, CAST(floor(max(ns) / 1e9) AS BIGINT) AS t1 FROM e)
"""
BUCKET = "least(239, CAST((({t}) - t0) * 240 // greatest(1, t1 - t0 + 1) AS INTEGER))"
SYMBOL = "CASE WHEN template IS NOT NULL THEN 'SRCH|' || template || '|' || scope ELSE type END"
WHAT = "CASE WHEN type = 'SRCH' THEN type || ' ' || base || ' ' || replace(filter, 'employeenumber', 'employeeNumber') WHEN event_id IS NULL THEN type ELSE type || ' uid=u' || k || ',ou=people,dc=example,dc=com' END"
STAMP = "strftime(make_timestamp_ns({ns}), '%Y-%m-%dT%H:%M:%S.%n') || 'Z'"

#: The lower edge of a bin with three significant digits.
BIN_LABEL = """(SELECT CASE WHEN digits LIKE '%.%' THEN rtrim(rtrim(digits, '0'), '.') ELSE digits END || unit FROM (SELECT printf(CASE WHEN x >= 99.99999 THEN '%.0f' WHEN x >= 9.999999 THEN '%.1f' ELSE '%.2f' END, x) AS digits, unit
        FROM (SELECT CASE WHEN e < 1 THEN e * 1000 WHEN e < 1000 THEN e ELSE e / 1000 END AS x, CASE WHEN e < 1 THEN ' µs' WHEN e < 1000 THEN ' ms' ELSE ' s' END AS unit FROM (SELECT 0.001 * pow(10.0, bin / 5.0) AS e))))"""

#: Name, query, and SQL.
REGISTERED: list[tuple[str, Query, str | None]] = [
    ("cost_by_account", on_operations(S.cost_by_account), f"{BASE} SELECT account, count(*) AS ops, {TIME} AS etime_total, round({TIME} / count(*), 6) AS etime_avg, round({TIME} / (SELECT {TIME} FROM ops), 6) AS share FROM ops GROUP BY account"),
    ("account_stats", on_operations(S.account_stats), f"{BASE} SELECT account, count(*) AS ops, {TIME} AS etime_total FROM ops GROUP BY account"),
    ("merged_accounts", merged_accounts, f"{BASE} SELECT account, count(*) AS ops, {TIME} AS etime_total FROM ops GROUP BY account"),
    ("summary_stats", on_stored(lambda e: S.summary_stats(e, O.build_operations(e), O.build_connections(e))), f"""{BASE} SELECT CAST(2 * (SELECT count(*) FROM ops) + 3 * count(*) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS unknown, count(*) AS opened, count(*) AS closed,
        (SELECT count(*) FROM ops WHERE type IN ('BIND', 'SRCH')) AS reads, (SELECT count(*) FROM ops WHERE type IN ('ADD', 'MOD')) AS writes, CAST(0 AS BIGINT) AS replication, CAST(0 AS BIGINT) AS starts, CAST(0 AS BIGINT) AS server_log, CAST(NULL AS VARCHAR) AS version,
        min(first_ns) AS first_ns, max(last_ns) AS last_ns, (SELECT string_agg(server, ',' ORDER BY server) FROM (SELECT DISTINCT server FROM u)) AS servers, (SELECT count(*) FROM ops) AS operations,
        (SELECT {TIME} FROM ops) AS etime_total, CAST(0 AS DOUBLE) AS qtime_total, round((SELECT CAST(sum(v) AS DOUBLE) / count(*) FROM ops WHERE type <> 'BIND'), 6) AS etime_avg_data,
        (SELECT CAST(max(v) AS DOUBLE) FROM ops) AS etime_max, (SELECT account FROM ops ORDER BY v DESC, account, {WHAT} LIMIT 1) AS etime_max_who, (SELECT {WHAT} FROM ops ORDER BY v DESC, account, {WHAT} LIMIT 1) AS etime_max_what,
        (SELECT CAST(max(v) AS DOUBLE) FROM u) AS connection_max, (SELECT account FROM u ORDER BY v DESC, account, 'conn=' || user_id LIMIT 1) AS connection_max_who, (SELECT 'conn=' || user_id FROM u ORDER BY v DESC, account, 'conn=' || user_id LIMIT 1) AS connection_max_what FROM u"""),
    ("operation_counts", on_events(S.operation_counts), f"{BASE} {LINES} SELECT label, CAST(sum(n) AS BIGINT) AS n FROM labels GROUP BY label"),
    ("read_write", on_events(S.read_write), f"{BASE} SELECT count(*) FILTER (type IN ('BIND', 'SRCH')) AS reads, count(*) FILTER (type IN ('ADD', 'MOD')) AS writes FROM ops"),
    ("result_codes", on_operations(lambda o: S.result_codes(o).withColumn("texts", F.array_join(F.transform("texts", lambda t: F.concat(t["text"], F.lit(" x"), t["n"].cast("string"))), "; "))), f"{BASE} SELECT err, name, class, count(*) AS n, CASE WHEN err = 0 THEN '' ELSE name || ' x' || count(*) END AS texts FROM ops JOIN codes ON err = code GROUP BY err, name, class"),
    ("errors_per_account", on_operations(S.errors_per_account), f"{BASE} SELECT account, err AS code, name, count(*) AS n, name || ' x' || count(*) AS texts FROM ops JOIN codes ON err = code WHERE err <> 0 GROUP BY account, err, name"),
    ("codes_by_class", on_operations(S.codes_by_class), f"{BASE} SELECT class, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM ops), 6) AS share FROM ops JOIN codes ON err = code GROUP BY class"),
    ("base_stats", on_both(S.base_stats), f"{BASE} SELECT base, count(*) AS n, {TIME} AS etime_total FROM ops WHERE base IS NOT NULL GROUP BY base"),
    ("top_bases", on_both(lambda e, o: K.top_bases(S.base_stats(e, o), 2)), f"{BASE} SELECT base, count(*) AS n, {TIME} AS etime_total FROM ops WHERE base IS NOT NULL GROUP BY base ORDER BY n DESC, base DESC LIMIT 2"),
    ("filter_stats", on_both(S.filter_stats), f"{BASE} SELECT filter, count(*) AS n, {TIME} AS etime_total FROM ops WHERE filter IS NOT NULL GROUP BY filter"),
    ("top_filters", on_both(lambda e, o: K.top_filters(S.filter_stats(e, o))), f"{BASE} SELECT filter, count(*) AS n, {TIME} AS etime_total FROM ops WHERE filter IS NOT NULL GROUP BY filter ORDER BY n DESC, filter DESC LIMIT 20"),
    ("compact_filters", on_both(lambda e, o: K.compact(S.filter_stats(e, o), "n", "filter", share=0.004)), f"{BASE}, f AS (SELECT filter, count(*) AS n, {TIME} AS etime_total FROM ops WHERE filter IS NOT NULL GROUP BY filter) SELECT filter, n, etime_total FROM (SELECT *, row_number() OVER (ORDER BY n DESC, filter) AS k, sum(n) OVER () AS total FROM f) WHERE k <= 10 OR n >= CAST(total AS DOUBLE) * 0.004"),
    ("filters_one_entry", on_operations(lambda o: S.filters_by_entries(o, 1)), f"{BASE} SELECT filter, count(*) AS n FROM ops WHERE nentries = 1 GROUP BY filter"),
    ("filters_no_entry", on_operations(lambda o: S.filters_by_entries(o, 0)), f"{BASE} SELECT filter, count(*) AS n FROM ops WHERE nentries = 0 GROUP BY filter"),
    ("wildcard_filters", on_events(S.wildcard_filters), f"{BASE} SELECT filter, count(*) AS n FROM ops WHERE contains(filter, '*') GROUP BY filter"),
    ("filters_per_account", on_operations(lambda o: S.filters_per_account(o, 5)), f"{BASE} SELECT account, CAST(rank AS INTEGER) AS rank, filter, n FROM (SELECT account, filter, count(*) AS n, row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, filter) AS rank FROM ops WHERE filter IS NOT NULL GROUP BY account, filter) WHERE rank <= 5"),
    ("bind_usage", lambda spark, d: S.bind_usage(O.bind_usage_rows(log_events(spark, d))), f"{BASE} SELECT what, name, count(*) AS n FROM u, (VALUES ('method', 'SIMPLE'), ('transport', 'ldap')) t(what, name) GROUP BY what, name"),
    ("load_by_server", on_both(S.load_by_server), f"{BASE} SELECT server, count(*) AS ops, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM ops), 6) AS share, {TIME} AS etime_total, count(*) FILTER (type = 'BIND') AS connections, count(*) FILTER (err <> 0) AS failures FROM ops GROUP BY server"),
    ("coverage_by_server", on_events(S.coverage_by_server), f"{BASE} SELECT server, min(ns) AS first_ns, max(ns) AS last_ns FROM e GROUP BY server"),
    ("cost_by_type", on_both(S.cost_by_type), f"{BASE} SELECT type, count(*) AS ops, {TIME} AS etime_total, round({TIME} / count(*), 6) AS etime_avg, round({TIME} / (SELECT {TIME} FROM ops), 6) AS share FROM ops GROUP BY type"),
    ("etime_by_hour", on_operations(P.etime_by_hour), f"{BASE} SELECT ns // 3600000000000 AS hour, account, {TIME} AS etime_total FROM ops GROUP BY 1, 2"),
    ("top_consumer_per_hour", on_operations(lambda o: P.top_consumer_per_hour(P.etime_by_hour(o))), f"{BASE}, h AS (SELECT ns // 3600000000000 AS hour, account, {TIME} AS etime_total FROM ops GROUP BY 1, 2) SELECT hour, account, etime_total FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY etime_total DESC, account) AS k FROM h) WHERE k = 1"),
    ("consumers_over_time", on_operations(lambda o: P.consumers_over_time(P.etime_by_hour(o), 6)), f"{BASE}, best AS (SELECT account FROM ops GROUP BY account ORDER BY sum(v) DESC, account LIMIT 6) SELECT ns // 3600000000000 AS hour, CASE WHEN account IN (SELECT account FROM best) THEN account ELSE 'other' END AS account, {TIME} AS etime_total FROM ops GROUP BY 1, 2"),
    ("filter_families", on_operations(P.filter_families), f"{BASE} SELECT account, template, count(*) AS n, {TIME} AS etime_total, CAST(sum(nentries) AS BIGINT) AS entries, min(nentries) AS entries_min, max(nentries) AS entries_max, round({TIME} / count(*), 6) AS etime_avg FROM ops WHERE template IS NOT NULL GROUP BY account, template"),
    ("family_cost", on_operations(lambda o: P.family_cost(P.filter_families(o))), f"{BASE} SELECT template, count(*) AS n, {TIME} AS etime_total FROM ops WHERE template IS NOT NULL GROUP BY template"),
    ("resource_hogs", on_operations(lambda o: P.resource_hogs(o, 0.3)), f"{BASE} SELECT account, template, count(*) AS n, {TIME} AS etime_total, round({TIME} / (SELECT {TIME} FROM ops), 6) AS share FROM ops WHERE template IN ('(cn=*$#*)', '(employeenumber=#*)') GROUP BY account, template HAVING {TIME} * 100 >= (SELECT {TIME} FROM ops) * 0.3"),
    ("resource_consumers", on_operations(S.resource_consumers), f"{BASE} SELECT account, 'etime' AS metric, round({TIME} / (SELECT {TIME} FROM ops), 6) AS share FROM ops GROUP BY account"),
    ("latency_histogram", on_operations(S.latency_histogram), f"""{BASE}, b(bucket, label, hi) AS (VALUES (0, '0', 0), (1, '0-1', 1), (2, '1-5', 5), (3, '5-10', 10), (4, '10-50', 50), (5, '50-100', 100), (6, '100-500', 500), (7, '500-1000', 1000), (8, '1000-2000', 2000), (9, '2000-5000', 5000), (10, '>5000', 1e18))
        SELECT bucket, label, count(v) AS n FROM b LEFT JOIN (SELECT v, (SELECT min(bucket) FROM b WHERE v <= hi) AS slot FROM ops) ON slot = bucket GROUP BY bucket, label"""),
    ("latency_density", on_operations(S.latency_density), f"{BASE}, b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(35)), o AS (SELECT v, CASE WHEN v <= 0.001 THEN 0 ELSE greatest(0, least(34, CAST(trunc((log10(CAST(v AS DOUBLE)) + 3) * 5) AS INTEGER))) END AS slot FROM ops) SELECT bin, {BIN_LABEL} AS label, count(v) AS n FROM b LEFT JOIN o ON slot = bin GROUP BY bin"),
    ("operation_sequences", on_operations(P.operation_sequences), f"""{BASE}, s AS (SELECT conn, account, op, {SYMBOL} AS s FROM ops),
        l AS (SELECT account, s, lag(s, 1) OVER w AS a, lag(s, 2) OVER w AS b, lag(s, 3) OVER w AS c FROM s WINDOW w AS (PARTITION BY conn ORDER BY op)),
        g AS (SELECT account, 2 AS length, a || ' > ' || s AS sequence FROM l WHERE a IS NOT NULL UNION ALL SELECT account, 3, b || ' > ' || a || ' > ' || s FROM l WHERE b IS NOT NULL
            UNION ALL SELECT account, 4, c || ' > ' || b || ' > ' || a || ' > ' || s FROM l WHERE c IS NOT NULL)
        SELECT account, sequence, CAST(length AS INTEGER) AS length, count(*) AS n FROM g GROUP BY account, sequence, length"""),
    ("operations", on_operations(lambda o: o.select("conn", "op", "life", "type", "who", "base", F.lower("filter").alias("filter"), "scope", "nentries", "err", "etime", "end_kind", "start_ts_ns", "end_ts_ns")), f"""{BASE} SELECT conn, op, CAST(0 AS BIGINT) AS life, type, account AS who, base, filter, scope, nentries, err, CAST(v AS DOUBLE) AS etime, CASE WHEN type = 'SRCH' THEN 'SEARCH_RESULT' ELSE 'RESULT' END AS end_kind, ns AS start_ts_ns, ns AS end_ts_ns FROM ops
        UNION ALL SELECT user_id, last_id + 2, 0, 'UNBIND', account, NULL, NULL, NULL, NULL, NULL, NULL, 'UNBIND', last_ns, last_ns FROM u"""),
    ("connections", on_connections(lambda c: c.select("conn", "server", "src", "who", "total_etime", "ops_count", "opened_ts_ns", "closed_ts_ns")), f"{BASE} SELECT user_id AS conn, server, '192.0.2.' || (user_id % 250) || ':' || (user_id + 40000) AS src, account AS who, CAST(v AS DOUBLE) AS total_etime, n + 1 AS ops_count, first_ns AS opened_ts_ns, last_ns AS closed_ts_ns FROM u"),
    ("top_operations", on_operations(lambda o: K.top_operations(o).select("conn", "op", "type", "who", "base", "err", "etime")), f"{BASE} SELECT conn, op, type, account AS who, base, err, CAST(v AS DOUBLE) AS etime FROM ops ORDER BY v DESC, conn, op LIMIT 100"),
    ("top_connections", on_connections(lambda c: K.top_connections(c).select("conn", "who", "total_etime", "ops_count")), f"{BASE} SELECT user_id AS conn, account AS who, CAST(v AS DOUBLE) AS total_etime, n + 1 AS ops_count FROM u ORDER BY v DESC, user_id LIMIT 100"),
    ("slowest_operation", on_operations(K.slowest_operation), f"{BASE} SELECT account AS who, {WHAT} AS description, CAST(v AS DOUBLE) AS etime FROM ops ORDER BY v DESC, account, description LIMIT 1"),
    ("slowest_connection", on_connections(K.slowest_connection), f"{BASE} SELECT account AS who, 'conn=' || user_id AS description, CAST(v AS DOUBLE) AS total_etime FROM u ORDER BY v DESC, account LIMIT 1"),
    ("concurrency", on_events(lambda e: split_order(L.concurrency_scan(stored(L.connection_events(e))))), f"{BASE} {DELTAS} SELECT t, event_id, CAST(phase AS BIGINT) AS phase, delta, open FROM opened"),
    ("concurrency_by_server", on_events(lambda e: L.concurrency_scan(stored(L.connection_events(e)), ("server",)).select("server", "t", event_of(F.col("ord")).alias("event_id"), "open")), f"{BASE}, d AS (SELECT server, CAST(floor(first_ns / 1e9) AS BIGINT) AS t, first_id AS event_id, -3 AS phase, 1 AS delta FROM u UNION ALL SELECT server, CAST(floor(last_ns / 1e9) AS BIGINT), last_id, 3, -1 FROM u) SELECT server, t, event_id, CAST(sum(delta) OVER (PARTITION BY server ORDER BY t, event_id, phase) AS BIGINT) AS open FROM d"),
    ("peak_connections", on_events(lambda e: L.peak_connections(e).select(F.col("peak").cast("bigint").alias("peak"))), f"{BASE} {DELTAS} SELECT max(open) AS peak FROM opened"),
    ("concurrency_series", on_events(lambda e: L.concurrency_series(e).select("bucket", F.col("peak").cast("bigint").alias("peak"))), f"""{BASE} {DELTAS}, b AS (SELECT {BUCKET.format(t='t')} AS bucket, max(open) AS most, arg_max(open, (t, event_id, phase)) AS last FROM opened, w GROUP BY 1),
        g AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(240)) SELECT g.bucket, CAST(greatest(coalesce(most, 0), coalesce(last_value(last IGNORE NULLS) OVER (ORDER BY g.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS peak FROM g LEFT JOIN b USING (bucket)"""),
    ("error_series", on_both(lambda e, o: L.error_series(e, o, keep=3)), f"""{BASE} {DELTAS}, x AS (SELECT CAST(err AS VARCHAR) AS code, {BUCKET.format(t='CAST(floor(ns / 1e9) AS BIGINT)')} AS bucket FROM ops, w WHERE err <> 0), best AS (SELECT code FROM x GROUP BY code ORDER BY count(*) DESC, code LIMIT 3)
        SELECT bucket, CASE WHEN code IN (SELECT code FROM best) THEN code ELSE 'other' END AS code, count(*) AS n FROM x GROUP BY 1, 2"""),
    ("replay_table", on_operations(sinks.replay_table), f"""{BASE} SELECT {STAMP.format(ns='ns')} AS timestamp, server, conn, op, type, account AS who, account AS binddn, base, CASE scope WHEN 0 THEN 'base' WHEN 1 THEN 'one' WHEN 2 THEN 'sub' END AS scope,
            replace(filter, 'employeenumber', 'employeeNumber') AS filter, CAST(NULL AS VARCHAR) AS attrs, CASE WHEN type IN ('MOD', 'ADD') THEN 'uid=u' || k || ',ou=people,dc=example,dc=com' END AS dn, err, nentries, CAST(v AS DOUBLE) AS etime, CAST(0 AS DOUBLE) AS qtime,
            CASE WHEN err <> 0 THEN name END AS text FROM ops JOIN codes ON err = code
        UNION ALL SELECT {STAMP.format(ns='last_ns')}, server, user_id, last_id + 2, 'UNBIND', account, account, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM u"""),
    ("syslog_counts", syslog_counts, f"""{BASE}, l AS (SELECT CASE WHEN type = 'SRCH' THEN 'SEARCH_RESULT' ELSE 'RESULT' END AS kind, server, ns FROM ops UNION ALL SELECT type, server, ns FROM ops
            UNION ALL SELECT 'ACCEPT', server, first_ns FROM u UNION ALL SELECT unnest(['CLOSED', 'UNBIND']), server, last_ns FROM u)
        SELECT kind, server, count(*) AS n, min(ns) // 1000000000 * 1000000000 AS first_ns, max(ns) // 1000000000 * 1000000000 AS last_ns FROM l GROUP BY kind, server"""),
    ("activity_by_bucket", on_events(lambda e: L.activity_by_bucket(e, 240)), f"""{BASE} {DELTAS}, l AS (SELECT type AS label, ns FROM ops UNION ALL SELECT CASE WHEN type = 'SRCH' THEN 'SEARCH RESULT' ELSE 'RESULT' END, ns FROM ops
        UNION ALL SELECT 'ACCEPT', first_ns FROM u UNION ALL SELECT unnest(['CLOSED', 'UNBIND']), last_ns FROM u) SELECT label, {BUCKET.format(t='CAST(floor(ns / 1e9) AS BIGINT)')} AS bucket, count(*) AS n FROM l, w GROUP BY 1, 2"""),
]


def queries() -> dict[str, Query]:
    return {name: query for name, query, _ in [*REGISTERED, *C.REGISTERED]}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in [*REGISTERED, *C.REGISTERED]}
