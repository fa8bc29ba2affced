"""Rebuilt operations, sessions, time series, rankings and state, with known answers."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from dirlog import queries as Q
from dirlog.operators import operations as O
from dirlog.operators import patterns as P
from dirlog.operators import ranking as K
from dirlog.operators import stats as S
from dirlog.operators import timeline as L
from dirlog.plans import events as E
from dirlog.session import tuned
from dirlog.sources import report, sinks
from dirlog.sources import state as St
from dirlog.sources.lines import LINES
from dirlog.streaming import ingest

SF = "/root/testdata/sf0.001"


def parse(spark, rows, file="f", host="h1", start="2026-08-05T14:{:02d}:{:02d}.000Z"):
    """rows: payloads, one a second, or (seconds, payload), or (seconds, host, payload)."""
    out = []
    for i, r in enumerate(rows):
        t, name, payload = (i, host, r) if isinstance(r, str) else (r[0], host, r[1]) if len(r) == 2 else r
        out.append((file, (0, i), f"{start.format(t // 60, t % 60)} {name} slapd[1]: {payload}"))
    return E.parse_openldap(spark.createDataFrame(out, LINES), year=2026)


def search(conn, op, flt, etime, n=1, err=0, base="dc=x"):
    return [f'conn={conn} op={op} SRCH base="{base}" scope=2 deref=0 filter="{flt}"', f"conn={conn} op={op} SEARCH RESULT tag=101 err={err} qtime=0 etime={etime} nentries={n} text="]


def bind(conn, dn="uid=a,dc=x", etime=1):
    return [f'conn={conn} op=0 BIND dn="{dn}" method=128', f"conn={conn} op=0 RESULT tag=97 err=0 qtime=0 etime={etime} text="]


def test_families_hogs_and_sequences(spark):
    ops = O.build_operations(parse(spark, bind(1) + search(1, 1, "(badge=71-*)", 800) + search(1, 2, "(badge=3-*)", 1200)))
    fam = P.filter_families(ops).first()
    assert (fam.template, fam.n, fam.etime_total) == ("(badge=#$*)", 2, 2000.0)
    assert [r.template for r in P.resource_hogs(ops).collect()] == ["(badge=#$*)"]
    seq = {r.sequence: r.n for r in P.operation_sequences(ops).collect()}
    s = "SRCH|(badge=#$*)|2"
    assert seq == {f"BIND > {s}": 1, f"{s} > {s}": 1, f"BIND > {s} > {s}": 1}


def test_lives_identity_and_inflight(spark):
    rows = bind(1) + search(1, 1, "(a=1)", 1) + search(1, 1, "(a=2)", 2) + ['conn=1 op=2 SRCH base="dc=x" scope=2 deref=0 filter="(a=3)"', "conn=2 op=5 RESULT tag=103 err=0 qtime=0 etime=3 text=", "conn=1 op=3 ABANDON msg=2", "conn=1 op=4 UNBIND"]
    ops = O.build_operations(parse(spark, rows))
    got = {(r.conn, r.op, r.life): (r.type, r.who, r.end_kind, r.filter) for r in ops.collect()}
    assert got[1, 1, 0] == ("SRCH", "uid=a,dc=x", "SEARCH_RESULT", "(a=1)") and got[1, 1, 1][3] == "(a=2)"
    assert got[1, 2, 0] == ("SRCH", "uid=a,dc=x", None, "(a=3)") and got[2, 5, 0] == (None, "unknown", "RESULT", None)
    assert got[1, 3, 0][0] == "ABANDON" and got[1, 4, 0][2] == "UNBIND"
    assert O.inflight_operations(ops).count() == 1
    replay = sinks.replay_table(ops).collect()
    assert len(replay) == len(got) and replay[0].type == "BIND" and len(replay[0]) == 17


def test_cluster_peak(spark):
    def conns(host, minute):
        a = [(minute * 60 + i, host, f"conn={i} fd=1 ACCEPT from IP=192.0.2.1:1 (IP=0:389)") for i in range(3)]
        return a + [(minute * 60 + 10 + i, host, f"conn={i} fd=1 closed") for i in range(3)]

    two = lambda m: parse(spark, conns("h1", 1), "f1").union(parse(spark, conns("h2", m), "f2"))
    assert L.peak_connections(two(1)).first().peak == 6
    assert L.peak_connections(two(5)).first().peak == 3
    assert L.peak_connections(parse(spark, conns("h1", 1))).first().peak == 3


def test_scan_equals_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "f", "h", (0, i), rng.choice([1, 1, -1, -1])) for i in range(500)]
    df = spark.createDataFrame(rows, "t long, file string, server string, ord struct<block:bigint,seq:bigint>, delta int")
    now, want = 0, []
    for r in rows:
        now = max(0, now + r[4])
        want.append(now)
    assert [r.open for r in L.concurrency_scan(df, ranges=7).orderBy("t").collect()] == want
    assert [r.open for r in L.concurrency(df).orderBy("t").collect()] == want


def test_scan_by_group_equals_loops(spark):
    import random

    rng = random.Random(9)
    rows = [(i // 3, f"f{rng.randrange(3)}", rng.choice([None, "h"]), (0, i), rng.choice([1, -1, -1])) for i in range(600)]
    df = spark.createDataFrame(rows, "t long, file string, server string, ord struct<block:bigint,seq:bigint>, delta int")
    now, want = {}, {}
    for r in rows:
        now[r[1], r[2]] = max(0, now.get((r[1], r[2]), 0) + r[4])
        want[r[3][1]] = now[r[1], r[2]]
    for ranges in (1, 5, 40):
        assert {r.ord.seq: r.open for r in L.concurrency_scan(df, ("file", "server"), ranges, ("t", "ord")).collect()} == want


def test_restarts_and_outages(spark):
    """The stop lies in one file and the start after it in the next, as after a rotation."""
    first = [(0, "slapd starting"), (300, "daemon: shutdown requested and initiated."), (302, "slapd stopped.")]
    second = [(900, "slapd starting"), (1500, "slapd starting"), (2000, "slapd stopped.")]
    e = parse(spark, first, "log.1").union(parse(spark, second, "log"))
    life = L.server_events(e)
    end = e.agg(F.max("ts_ns")).first()[0]
    zero = e.agg(F.min("ts_ns")).first()[0]
    assert [(r.down_ns - zero, r.up_ns - zero) for r in L.outages(life, end).collect()] == [(300 * 10**9, 900 * 10**9)]
    assert sorted((r.down_ns - zero, r.up_ns - zero) for r in L.outages(life, end + 60 * 10**9).collect()) == [(300 * 10**9, 900 * 10**9), (2000 * 10**9, 2060 * 10**9)]
    assert [(r.file, r.ts_ns - zero) for r in L.abrupt_restarts(life).collect()] == [("log", 1500 * 10**9)]
    busy = e.union(parse(spark, [(700, "conn=1 fd=1 closed")], "log.1"))
    assert L.corroborated_outages(L.outages(life, end), e).count() == 1 and L.corroborated_outages(L.outages(life, end), busy).count() == 0
    got = sorted((r.file, r.ord.seq, r.restart) for r in O.restart_epoch(e).select("file", "ord", "restart").collect())
    assert got == [("log", 0, 0), ("log", 1, 1), ("log", 2, 2), ("log.1", 0, 0), ("log.1", 1, 1), ("log.1", 2, 1)]


def test_restarts_of_a_long_file(spark, monkeypatch):
    """A line is held against the starts of its own part of the file, never against all of them."""
    at = [(b, 50_000 * i + 3) for b in (0, 7, 9) for i in range(12)]
    rows = [("f", (b, q), "SLAPD_STARTING") for b, q in at] + [("f", (b, q + d), "SRCH") for b, q in at for d in (-2, 2)] + [("g", (b, q), "SRCH") for b, q in at]
    e = spark.createDataFrame(rows, "file string, ord struct<block:bigint,seq:bigint>, kind string")
    held, small = [], O.small
    monkeypatch.setattr(O, "small", lambda df, *more: (held.append(df), small(df, *more))[1])
    got = {(r.file, tuple(r.ord)): r.restart for r in O.restart_epoch(e).collect()}
    assert got == {(f, o): sum(f == "f" and a < o for a in at) for f, o, _ in rows}
    arrays = [(df, c) for df in held for c, kind in df.dtypes if kind.startswith("array")]
    assert arrays and all(df.agg(F.max(F.size(c))).first()[0] <= 3 for df, c in arrays)


def test_tasks_stay_small(spark):
    """A session's owner gets small tasks and enough partitions for them; what is smaller already stays."""
    start = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for size in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        old = spark.conf.get(size)
        for given, want in (("128MB", 16 << 20), ("8m", 8 << 20)):
            spark.conf.set(size, given)
            assert int(tuned(spark).conf.get(size).rstrip("b")) == want and int(spark.conf.get(start)) >= 200
        spark.conf.set(size, old)


def test_load_of_a_server_without_results(spark):
    e = parse(spark, bind(1)).union(parse(spark, ["conn=1 fd=1 ACCEPT from IP=192.0.2.1:1 (IP=0:389)"], "g", "h9"))
    got = {r.server: (r.ops, r.share, r.connections, r.failures) for r in S.load_by_server(e, O.build_operations(e)).collect()}
    assert got == {"h1": (1, 1.0, 0, 0), "h9": (0, 0.0, 1, 0)}


def test_version_banner(spark):
    e = parse(spark, ["@(#) $OpenLDAP: slapd 2.5.19+lab (Mar  9 2025 17:20:41) $", "slapd starting", 'conn=1 op=1 SRCH base="cn=OpenLDAP slapd 9.9" scope=0 deref=0 filter="(a=b)"'])
    v = E.parse_version_banner(e)
    assert v.first().version == "2.5.19+lab" and L.server_events(e, v).first().label == "start (OpenLDAP 2.5.19+lab)"


def test_sessions(spark):
    rows = ["conn=1 fd=1 ACCEPT from IP=10.0.0.1:99 (IP=0:389)", "conn=1 op=0 [IP=1.2.3.4 NAME=app k=v USERNAME=bob] BIND dn=\"uid=a,dc=x\" method=128", "conn=1 op=0 RESULT tag=97 err=0 qtime=0 etime=0 text=", "conn=1 op=1 [IP=1.2.3.4 NAME=app USERNAME=bob] UNBIND",
            "slapd starting", "conn=1 fd=1 ACCEPT from IP=10.0.0.2:98 (IP=0:389)", "conn=1 op=1 [IP=1.2.3.4 NAME=app] UNBIND"]
    c = O.session_correlations(parse(spark, rows))
    got = {r.restart: (r.real_ip, r.name, r.username, r.accept) for r in c.collect()}
    assert got == {0: ("1.2.3.4", "app k=v", "bob", "10.0.0.1:99"), 1: ("1.2.3.4", "app", None, "10.0.0.2:98")}
    g = S.session_groups(c.withColumn("username", F.lit("bob"))).first()
    assert (g.name, g.sessions, g.nat_hosts) == ("app", 2, 2)
    assert O.distinct_correlations(c.union(c)).count() == 2


def test_paged_searches(spark):
    ctl = '=> get_ctrls: oid="1.2.840.113556.1.4.319" (critical)'
    e = parse(spark, bind(1) + [ctl, *search(1, 1, "(a=b)", 1), ctl, *search(1, 2, "(a=b)", 1), '=> get_ctrls: oid="1.2.3" (critical)', "conn=1 op=3 UNBIND"])
    assert [(r.account, r.pages) for r in S.paged_searches(O.paged_by_control(e)).collect()] == [("uid=a,dc=x", 2)]
    run = search(1, 1, "(a=b)", 1, 100) + search(1, 2, "(a=b)", 1, 100) + search(1, 3, "(a=b)", 1, 7)
    closed = parse(spark, bind(1) + run + ["conn=1 fd=1 closed"])
    assert [r.pages for r in O.paged_by_shape(closed, O.build_operations(closed)).collect()] == [3]
    open_end = parse(spark, bind(1) + run)
    assert O.paged_by_shape(open_end, O.build_operations(open_end)).count() == 0


def test_errors_and_classes(spark):
    rows = []
    for err, n in ((49, 30), (32, 10), (53, 2), (5, 3)):
        for i in range(n):
            rows += search(err, i + 1, "(a=b)", 1, 0, err)
    e = parse(spark, rows)
    ops = O.build_operations(e)
    assert {r.code: r.n for r in S.errors_per_account(ops).collect()} == {49: 30, 32: 10, 53: 2}
    assert {r.code: r.n for r in L.error_series(e, ops, keep=2).groupBy("code").agg(F.sum("n").alias("n")).collect()} == {"49": 30, "32": 10, "other": 2}
    assert {r["class"]: r.n for r in S.codes_by_class(ops).collect()} == {"client": 40, "policy-or-client": 2, "informational": 3}


def test_counters(spark):
    rows = ['conn=1 op=1 SRCH base="dc=x" scope=0 deref=0 filter="(?=undefined)(?foo)"', "conn=1 op=1 SRCH attr=CN mail", "conn=1 op=2 MOD attr=mail", "conn=1 op=3 EXT oid=1.3.6.1.1.8", "<= mdb_equality_candidates: (Mail) not indexed", "slap_queue_csn: queueing 0x1 2026", 'ldap_back_dobind_int: DN="cn=relay,o=lab" without creds', "slap_global_control: unrecognized control: oid=1.2.3", "what is this"]
    e = parse(spark, rows)
    assert {r.attr: r.n for r in S.attribute_counts(e).collect()} == {"cn": 1, "mail": 2}
    assert {r.attr: r.n for r in S.qmark_filters(e).collect()} == {"=undefined": 1, "foo": 1}
    assert S.extended_ops(e).first().name == "Cancel" and S.not_indexed(e).first().attr == "mail"
    assert S.csn_events(e).first().n == 1 and S.misc_counters(e).first().what == "rebind failed" and S.global_controls(e).first().oid == "1.2.3"
    assert sinks.unknown_lines(e).count() == 1


def test_onset(spark):
    hours = [(h, "quiet" if h < 60 or h % 13 == 0 else "new", 1.0) for h in range(100, 200)]
    hours = [(h, "quiet" if i < 60 else "new" if i % 13 else "quiet", 1.0) for i, (h, _, _) in enumerate(hours)]
    found = P.onsets(spark.createDataFrame(hours, "hour long, account string, etime_total double")).collect()
    assert [(r.account, r.hour) for r in found] == [("new", 160)]
    even = [(h, "a" if h % 2 else "b", 1.0) for h in range(100)]
    assert P.onsets(spark.createDataFrame(even, "hour long, account string, etime_total double")).count() == 0


def test_uncovered_and_ranking(spark):
    c = spark.createDataFrame([("a", 0, 10), ("b", 5, 20), ("c", 30, 40)], "server string, first_ns long, last_ns long")
    assert [r[:] for r in L.uncovered_spans(c).collect()] == [(20, 30)] and L.uncovered_spans(c.limit(1)).count() == 0
    t = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "k string, n long")
    assert [r.k for r in K.ranked(t, "k", "n", 2).collect()] == ["a", "b"] and [r.k for r in K.ranked(t, "k", "n", 2, "desc").collect()] == ["b", "a"]
    assert {r.k: r.n for r in K.keep_top(t, 1, "k", "n").collect()} == {"a": 5, "other": 6}
    assert K.compact(t, "n", "k", keep=1, share=0.4).count() == 2


def log_text(users, host, start=0):
    rows = []
    for u in users:
        for i, p in enumerate([f"conn={u} fd=1 ACCEPT from IP=192.0.2.1:{u} (IP=0:389)", *bind(u, f"uid=u{u},dc=x"), *search(u, 1, f"(uid=u{u})", 0.5 + u), *search(u, 2, "(cn=a*)", 0.25, 0, 32), f"conn={u} op=3 UNBIND", f"conn={u} fd=1 closed"]):
            t = start + u * 20 + i
            rows.append(f"2026-08-05T14:{t // 60:02d}:{t % 60:02d}.000Z {host} slapd[1]: {p}")
    return "\n".join(rows) + "\n"


def content(tables):
    """Sorted rows of each table; files' folders do not count."""
    out = {}
    for name, df in tables.items():
        cols = sorted(c for c in df.columns if c not in ("file", "ord", "start_ord", "end_ord"))
        out[name] = sorted(map(str, df.select(*cols).collect()))
    return out


def test_split_equals_single_and_foreign_servers(spark, tmp_path):
    for i, users in enumerate((range(0, 4), range(4, 8))):
        (tmp_path / f"part{i}.log").write_text(log_text(users, "ldap1"))
    a, b = (str(tmp_path / f"part{i}.log") for i in range(2))
    once = content(St.partials(ingest.parse_paths(spark, [a, b])))
    first = ingest.ingest_batch(spark, [a], str(tmp_path / "s"), 1)
    ingest.ingest_batch(spark, [b], str(tmp_path / "s"), 2, previous=1)
    assert content(St.load_state(spark, str(tmp_path / "s/2"))) == once
    alone = ingest.ingest_batch(spark, [b], str(tmp_path / "t"), 1)
    assert content(St.load_state(spark, first, alone)) == content(St.load_state(spark, alone, first)) == once
    (tmp_path / "part9.log").write_text(log_text(range(3), "ldap7"))
    with pytest.raises(ValueError, match="ldap7"):
        ingest.ingest_batch(spark, [str(tmp_path / "part9.log")], str(tmp_path / "s"), 3, previous=2)
    assert not (tmp_path / "s/3").exists()


def test_stream_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text(log_text(range(3), "ldap1"))
    watch = lambda: ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    watch()
    (tmp_path / "in/b.log").write_text(log_text(range(3, 5), "ldap1"))
    watch()
    latest = max(ingest.generations(spark, str(tmp_path / "s")), key=int)
    assert St.load_state(spark, str(tmp_path / "s" / latest))["accounts"].count() == 5


def test_stream_goes_on_after_a_new_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text(log_text(range(3), "ldap1"))
    ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c1")).awaitTermination()
    (tmp_path / "in/a.log").unlink()
    (tmp_path / "in/b.log").write_text(log_text(range(3, 5), "ldap1"))
    ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(ingest.generations(spark, str(tmp_path / "s")), key=int) == ["0", "1"]
    assert St.load_state(spark, str(tmp_path / "s/1"))["accounts"].count() == 5


def test_sinks(spark, tmp_path):
    e = parse(spark, bind(1) + search(1, 1, "(a=b)", 1) + ["rubbish"])
    ops = O.build_operations(e)
    assert sinks.write_unknown_lines(e, str(tmp_path / "u")) == 1
    sinks.write_replay(ops, str(tmp_path / "r"), "\t", 0)
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.write_replay(ops, str(tmp_path / "r2"), ";")


def test_report(spark, tmp_path):
    e = parse(spark, ["conn=1 fd=1 ACCEPT from IP=192.0.2.1:1 (IP=0:389)", *bind(1, etime=3), *search(1, 1, "(a=b*)", 1, 0, 32), "rubbish", "conn=1 fd=1 closed"])
    state = St.partials(e)
    report.write_report(state, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/cost_by_account")).first().ops == 2
    doc = json.loads(report.build_report(state))
    assert (doc["lines"], doc["unknown_lines"], doc["connections_opened"], doc["peak_active_connections"], doc["etime_total"]) == (7, 1, 1, 1, 4.0)
    assert (doc["max_etime"], doc["max_etime_user"], doc["max_conn_etime_desc"]) == (3.0, "uid=a,dc=x", "conn=1")
    assert doc["error_counts"]["32"]["count"] == 1 and doc["error_counts_by_app"]["uid=a,dc=x"]["32"]["name"] == "noSuchObject"
    assert doc["cost_by_account"]["uid=a,dc=x"] == {"ops": 2, "etime_total": 4.0, "avg_etime": 2.0, "share": 100.0} and doc["operation_counts"]["SRCH"] == 1
    assert doc["resource_hogs"][0]["template"] == "(a=$*)" and doc["filter_families"]["uid=a,dc=x"]["(a=$*)"]["count"] == 1


def test_oracle_pairs(spark):
    """A few of the registered queries against their SQL; the driver compares them all."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    sql = Q.oracle_sql()
    for name in ("cost_by_account", "summary_stats", "filter_families", "concurrency_series"):
        df = Q.queries()[name](spark, SF)
        cur = con.execute(sql[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        clean = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted((tuple(clean(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall()), key=str)
        assert sorted((tuple(clean(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str) == want


def test_all_texts_of_a_code(spark):
    rows = bind(1)
    for i in range(150):
        rows += search(1, i + 1, "(a=b)", 1, 0, 53)
        rows[-1] += f"reason {i:03d}"
    ops = O.build_operations(parse(spark, rows))
    want = [f"reason {i:03d}" for i in range(150)]
    code = next(r for r in S.result_codes(ops).collect() if r.err == 53)
    assert code.n == 150 and [(t.text, t.n) for t in code.texts] == [(w, 1) for w in want]
    account = S.errors_per_account(ops).first()
    assert account.n == 150 and account.texts == "; ".join(f"{w} x1" for w in want)
    assert [len(r.texts) for r in S.result_codes(ops, keep=3).where("err = 53").collect()] == [3]
