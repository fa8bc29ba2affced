"""Parsing of every dialect, with the numbers that follow from the lines."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import os
import time

import pytest
from pyspark.sql import functions as F

from dirlog.functions import codes, filters
from dirlog.functions import timestamps as T
from dirlog.operators import operations as O
from dirlog.operators import stats as S
from dirlog.plans import events as E
from dirlog.sources import lines as L

OPENLDAP = """conn=1 fd=12 ACCEPT from IP=192.0.2.10:1111 (IP=0.0.0.0:389)
conn=1 op=0 BIND dn="uid=a,dc=example,dc=com" method=128
conn=1 op=0 BIND dn="uid=a,dc=example,dc=com" mech=EXTERNAL bind_ssf=0 ssf=0
conn=1 op=0 RESULT tag=97 err=0 qtime=0.00001 etime=0.5 text=
conn=1 op=1 SRCH base="dc=example,dc=com" scope=2 deref=0 filter="(uid=a)"
conn=1 op=1 SRCH attr=cn mail
conn=1 op=1 SEARCH RESULT tag=101 err=0 qtime=0.00001 etime=0.002 nentries=1 text=
conn=1 op=2 MOD dn="uid=b,dc=example,dc=com"
conn=1 op=2 MOD attr=mail
conn=1 op=2 RESULT tag=103 err=50 qtime=0 etime=1 text=no write access
conn=1 op=3 [IP=203.0.113.8 NAME=gate-2 USERNAME=cn=robot,o=lab] SRCH base="dc=x" scope=0 deref=0 filter="(?=undefined)(?foo)"
conn=1 op=4 ABANDON msg=3
conn=1 op=5 UNBIND
conn=1 op=6 EXT oid=1.3.6.1.4.1.1466.20037
conn=1 op=7 STARTTLS
conn=1 op=8 BIND anonymous mech=implicit bind_ssf=0 ssf=0
conn=1 op=9 BIND authcid="a" authzid="b"
conn=1 op=10 DEL dn="uid=z,dc=example,dc=com"
conn=1 op=11 TRACK IP=1.2.3.4, NAME=web, USERNAME=bob
conn=1 fd=12 TLS established tls_ssf=256 ssf=256
conn=1 fd=12 closed (connection lost)
=> get_ctrls: oid="1.2.840.113556.1.4.319" (noncritical)
<= mdb_equality_candidates: (mail) not indexed
slap_queue_csn: queueing 0x7f 20260101000000.000000Z#000000#001#000000
slapd starting
slapd stopped.
daemon: shutdown requested and initiated.
slapd shutdown: waiting for 0 operations/tasks to finish
connection_input: conn=9 deferring operation: too many executing
critical control "1.2.3" not supported; stripped.
nonsense without sense""".split("\n")


def as_lines(spark, rows, file="f"):
    return spark.createDataFrame([(file, (0, i), r) for i, r in enumerate(rows)], L.LINES)


def stamped(rows, head="2026-08-05T14:23:01.5Z h1 slapd[1]: "):
    return [head + r for r in rows]


def test_openldap_kinds_and_fields(spark):
    e = E.parse_openldap(as_lines(spark, stamped(OPENLDAP)), year=2026)
    assert e.columns == [n for n, _ in E.EVENT_FIELDS]
    got = {r.ord.seq: r for r in e.collect()}
    kinds = "ACCEPT BIND BIND_DN_INFO RESULT SRCH SRCH_ATTR SEARCH_RESULT MOD MOD RESULT SRCH ABANDON UNBIND EXT STARTTLS BIND_ANON BIND_AUTH DEL TRACK TLS CLOSED GET_CTRLS NOT_INDEXED CSN_QUEUE SLAPD_STARTING SLAPD_STOPPED DAEMON_SHUTDOWN SLAPD_SHUTDOWN CONN_DEFER CONTROL_NOT_SUPPORTED UNKNOWN_LINE"
    assert [got[i].kind for i in range(len(OPENLDAP))] == kinds.split()
    assert (got[0].src, got[0].fd, got[0].server, got[0].proc) == ("192.0.2.10:1111", 12, "h1", "slapd[1]")
    assert (got[1].binddn, got[1].method, got[2].mech) == ("uid=a,dc=example,dc=com", 128, "EXTERNAL")
    assert (got[6].nentries, got[6].etime, got[6].err, got[6].tag) == (1, 0.002, 0, 101)
    assert (got[9].err, got[9].text) == (50, "no write access")
    assert (got[10].session_ip, got[10].session_name, got[10].session_username, got[10].base) == ("203.0.113.8", "gate-2", "cn=robot,o=lab", "dc=x")
    assert got[18].track == {"IP": "1.2.3.4", "NAME": "web", "USERNAME": "bob"} and got[18].session_username == "bob"
    assert (got[20].reason, got[21].oid, got[22].attrs) == ("connection lost", "1.2.840.113556.1.4.319", "mail")


def test_headers_and_forced_formats(spark):
    rows = ["6a734745.1f4b2c3a 0x7f9c conn=1 op=1 UNBIND", "2026-08-05T14:23:01+02:00 h p: conn=1 op=1 UNBIND", "[2026-08-05T14:23:01.123Z] conn=1 op=1 UNBIND", "Aug  5 14:23:01 h p: conn=1 op=1 UNBIND", "rubbish"]
    got = E.parse_header(as_lines(spark, rows), year=2026).select("format", T.format_timestamp(F.col("ts_ns")).alias("t"), "payload").collect()
    assert [r.format for r in got] == ["debug", "rfc3339", "ol26", "syslog", None]
    assert [r.t for r in got] == ["2026-08-05T14:23:01.525020218Z", "2026-08-05T12:23:01.000000000Z", "2026-08-05T14:23:01.123000000Z", "2026-08-05T14:23:01.000000000Z", None]
    assert got[4].payload is None
    forced = E.parse_header(as_lines(spark, rows), "ol26", 2026).where("payload is not null").collect()
    assert len(forced) == 1
    with pytest.raises(ValueError):
        E.parse_header(as_lines(spark, rows), "nope", 2026)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("389ds", "04/Feb/2025:23:59:58.900000001 -0330"), ("opendj", "05/Feb/2025:09:15:00 -0500"), ("syslog-localtime", "Aug  5 14:23:01"), ("rfc3339", "2026-02-30T00:00:00Z")], "f string, t string")
        got = [r.ns for r in df.select(T.to_epoch_ns(F.col("t"), F.col("f"), 2026, "Europe/Paris").alias("ns")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1738726198900000001, 1738764900000000000, 1785932581000000000, None]


DS389 = """\t389-Directory/1.4.4.19 B2025.184.0915
\tdir3.lab.test:636 (/etc/dirsrv/slapd-dir3)

[04/Feb/2025:23:59:58.900000001 -0330] conn=41 fd=113 slot=113 SSL connection from 198.51.100.77 to 198.51.100.2
[04/Feb/2025:23:59:58.950000000 -0330] conn=41 TLSv1.3 128-bit AES-GCM
[04/Feb/2025:23:59:59.000000000 -0330] conn=41 op=3 BIND dn="uid=sync,ou=agents,o=lab" method=sasl version=3 mech="DIGEST-MD5"
[04/Feb/2025:23:59:59.250000000 -0330] conn=41 op=3 RESULT err=14 tag=97 nentries=0 wqtime=0.004 optime=0.2 etime=0.25, SASL bind in progress
[05/Feb/2025:00:00:01.000000007 -0330] conn=41 op=4 SRCH base="ou=hosts,o=lab" scope=1 filter="(&(objectClass=ipHost)(cn=node-9*))" attrs="cn ipHostNumber"
[05/Feb/2025:00:00:02.500000000 -0330] conn=41 op=4 RESULT err=4 tag=101 nentries=2000 wqtime=0.01 etime=1.5 notes=A,P
[05/Feb/2025:00:00:03.000000000 -0330] conn=41 op=5 MOD dn="cn=node-9,ou=hosts,o=lab"
[05/Feb/2025:00:00:03.125000000 -0330] conn=41 op=5 RESULT err=50 tag=103 nentries=0 wqtime=0.02 etime=0.125 - no write right on node-9
[05/Feb/2025:00:00:03.500000000 -0330] conn=41 op=6 ABANDON targetop=4 msgid=5 nentries=17 etime=2.5
[05/Feb/2025:00:00:04.000000000 -0330] conn=41 op=-1 fd=113 Disconnect - Idle timeout exceeded - T1
[05/Feb/2025:00:10:00.000000000 -0330] conn=52 (Internal) op=8(3)(1) ADD dn="cn=plugin job,cn=tasks,cn=config"
[05/Feb/2025:00:10:00.000000500 -0330] conn=Internal(6) op=2(1)(4) RESULT err=0 tag=48 nentries=0 etime=0.0000005
[05/Feb/2025:00:11:00.000000000 -0330] conn=53 AUTOBIND dn="cn=root agent,o=lab"
[05/Feb/2025:00:12:00.000000000 -0330] conn=53 op=1 WHATEVER x=1
not a line of any log""".split("\n")


def test_ds389_text(spark):
    got = {r.ord.seq: r for r in E.parse_ds389_text(as_lines(spark, DS389)).collect()}
    kinds = ["TITLE"] * 3 + "ACCEPT TLS BIND RESULT SRCH SEARCH_RESULT MOD RESULT ABANDON CLOSED ADD RESULT DS_AUTOBIND UNKNOWN_OP UNKNOWN_LINE".split()
    assert [got[i].kind for i in range(len(DS389))] == kinds
    assert (got[3].src, got[3].fd, got[3].ts_ns, got[5].method, got[5].mech) == ("198.51.100.77", 113, 1738726198900000001, 163, "DIGEST-MD5")
    assert (got[7].base, got[7].scope, got[7].filter, got[7].attrs) == ("ou=hosts,o=lab", 1, "(&(objectClass=ipHost)(cn=node-9*))", "cn ipHostNumber")
    assert (got[8].nentries, got[8].etime, got[8].qtime, got[8].not_indexed) == (2000, 1.5, 0.01, True) and got[6].not_indexed is None
    assert (got[10].err, got[10].text, got[11].etime, got[11].msgid) == (50, "no write right on node-9", 2.5, 5)
    assert (got[12].op, got[12].reason) == (None, "Idle timeout exceeded - T1")
    assert (got[13].conn, got[13].op, got[14].conn, got[14].op, got[15].binddn) == (52, 8, 6, 2, "cn=root agent,o=lab")


def test_ds389_json_and_pretty(spark, tmp_path):
    rows = [
        '{"header":{"version":"389-Directory/3.1","instance":"lab"}}',
        '{"local_time":"2025-02-05T00:00:00.5 -0330","operation":"CONNECTION","conn_id":41,"fd":113,"client_ip":"198.51.100.77"}',
        '{"local_time":"2025-02-05T00:00:01.000000009 -0330","operation":"BIND","conn_id":41,"op_id":3,"bind_dn":"uid=sync,o=lab","method":"sasl","mech":"PLAIN"}',
        '{"local_time":"2025-02-05T00:00:02 -0330","operation":"SEARCH","conn_id":-1,"op_id":-1,"base_dn":"o=lab","scope":1,"filter":"(cn=*)","attrs":[]}',
        '{"local_time":"2025-02-05T00:00:03 -0330","operation":"RESULT","conn_id":41,"op_id":4,"tag":101,"err":4,"nentries":2000,"etime":1.5,"wqtime":"0.01","notes":[{"note":"P"},{"note":"A"}]}',
        "{ cut off",
    ]
    got = {r.ord.seq: r for r in E.PARSERS["ds389-json"](as_lines(spark, rows)).collect()}
    assert [got[i].kind for i in range(6)] == ["TITLE", "ACCEPT", "BIND", "SRCH", "SEARCH_RESULT", "UNKNOWN_LINE"]
    assert (got[2].method, got[2].ts_ns, got[3].conn, got[3].op, got[3].attrs) == (163, 1738726201000000009, 0, None, "ALL")
    assert (got[4].etime, got[4].qtime, got[4].not_indexed) == (1.5, 0.01, True)
    (tmp_path / "p.log").write_text(PRETTY)
    records = L.read_json_pretty(spark, str(tmp_path / "p.log"))
    assert sorted(r.kind for r in E.PARSERS["ds389-json-pretty"](records).collect()) == ["ACCEPT", "CLOSED", "TITLE"]


PRETTY = """{
  "header": {
    "version": "389-Directory/3.1"
  }
}
{
  "local_time": "2025-02-05T00:00:00.5 -0330",
  "operation": "CONNECTION",
  "conn_id": 41
}
{
  "local_time": "2025-02-05T00:00:09.5 -0330",
  "operation": "DISCONNECT",
  "conn_id": 41,
  "close_reason": "a } in {\\"words\\"}"
}
"""


def test_json_records_in_any_layout(spark, tmp_path):
    """Indented, inline, joined and one-line records; braces in strings; broken records and prose become unknown, alone; across splits too."""
    record = lambda i, text="x": {"local_time": "2025-02-05T00:00:00.5 -0330", "operation": "RESULT", "conn_id": i, "op_id": i, "msg": text, "notes": [{"note": "P"}, {"note": "A"}]}
    texts = ["a } in {", '"}', "\\", "}{", ",", 'end\\"']
    parts, want = [], []
    for i in range(120):
        r = record(i, texts[i % len(texts)])
        pretty = json.dumps(r, indent=2 + i % 3)
        layout = i % 5
        parts.append({0: pretty, 1: "\n".join("    " + x for x in pretty.split("\n")), 2: json.dumps(r), 3: pretty.replace("\n}", "}"), 4: pretty.replace("},\n", "}\n,\n")}[layout])
        want.append((i, r["msg"]))
        if i % 17 == 5:
            parts.append(pretty[: pretty.index('"msg"')].rstrip())  # breaks off behind a comma
        elif i % 17 == 9:
            parts.append(pretty[: pretty.index('"op_id"') + 4])  # within a name
        elif i % 17 == 13:
            parts.append("no JSON at all\nand more of it")
    parts.append("{")
    unknown = sum(i % 17 in (5, 9) for i in range(120)) + 2 * sum(i % 17 == 13 for i in range(120)) + 1
    for name, joint in (("lines", "\n"), ("blank", "\r\n \r\n")):
        (tmp_path / f"{name}.log").write_text(joint.join(parts))
    (tmp_path / "joined.log").write_text("".join(json.dumps(record(i)) for i in range(3)) + " " + json.dumps(record(3), indent=1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "700", "90"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        for name in ("lines", "blank"):
            got = E.PARSERS["ds389-json-pretty"](L.read_json_pretty(spark, str(tmp_path / f"{name}.log"))).collect()
            assert sorted((r.conn, r.text) for r in got if r.kind == "RESULT") == want
            assert len(got) == len(want) + unknown and all(r.kind in ("RESULT", "UNKNOWN_LINE") for r in got)
            assert [r.conn for r in sorted(got, key=lambda r: r.ord) if r.kind == "RESULT"] == list(range(120))
        assert sorted(r.conn for r in E.PARSERS["ds389-json-pretty"](L.read_json_pretty(spark, str(tmp_path / "joined.log"))).collect()) == [0, 1, 2, 3]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_records_are_cut_where_they_are_read(spark, tmp_path):
    """Only the ends of splits are shuffled, whatever the layout; records go on over batches and splits of any size."""
    record = lambda i: json.dumps({"operation": "RESULT", "conn_id": i, "msg": "a } {é" * (i % 3), "notes": [{"note": "P"}, {"note": "A"}]}, indent=i % 4 or None, ensure_ascii=False)
    want = [record(i) for i in range(60)]
    (tmp_path / "p.log").write_text("\n".join(want[:30]) + "\n\n" + " ".join(want[30:33]) + "\n" + "\n".join(want[33:]))
    path = str(tmp_path / "p.log")
    plan = L.read_json_pretty(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "explode" not in plan
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for split, batch in ((sizes["spark.sql.files.maxPartitionBytes"], 3), ("300", 2), ("40", 10_000)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = [json.loads(r.raw) for r in L.read_json_pretty(spark, path).orderBy("ord", F.regexp_extract("raw", r'conn_id": ?(\d+)', 1).cast("int")).collect()]
        assert got == [json.loads(x) for x in want]
    for k, v in sizes.items():
        spark.conf.set(k, v)
    lines = L.read_lines(spark, path)
    mixed = lines.repartition(3, F.xxhash64("ord"))
    with pytest.raises(Exception, match="not together"):
        L.as_records(mixed).collect()


def test_every_file_of_a_folder_is_read(spark, tmp_path):
    """Plain, gzip, bzip2 under another ending, xz and pretty JSON together equal their single reads; nothing is left out silently."""
    plain = "\n".join(stamped(OPENLDAP)) + "\n"
    (tmp_path / "slapd.log").write_text(plain)
    for name, opener, body in (("slapd.log.gz", gzip.open, plain), ("slapd.log.bz2_2026-03-01", bz2.open, plain), ("ldap.xz", lzma.open, "\n".join(DS389)), ("ldap-pretty.xz", lzma.open, PRETTY)):
        with opener(tmp_path / name, "wt") as f:
            f.write(body)
    (tmp_path / "ldap-pretty.log").write_text(PRETTY)
    (tmp_path / "ldap-empty.log").write_text("")
    (tmp_path / "ldap-prose.log").write_text("once upon a time\n")
    (tmp_path / "ldap-broken.xz").write_bytes(b"\xfd7zXZ\x00 nothing")
    events = E.read_events(spark, str(tmp_path))
    got = {r.name: (r.n, r.unknown) for r in events.groupBy(F.element_at(F.split("file", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "UNKNOWN_LINE").alias("unknown")).collect()}
    n = len(OPENLDAP)
    assert got == {"slapd.log": (n, 1), "slapd.log.gz": (n, 1), "slapd.log.bz2_2026-03-01": (n, 1), "ldap.xz": (len(DS389), 1), "ldap-pretty.log": (3, 0), "ldap-pretty.xz": (3, 0)}
    seen = {r.file.rsplit("/", 1)[1]: (r.kind, r.kept, r.reason, r.compression) for r in L.inspect_files(spark, L.list_files(spark, str(tmp_path))).collect()}
    assert seen["ldap-empty.log"] == ("empty", False, "empty", None) and seen["ldap-prose.log"] == ("not-a-log", False, "not a log", None)
    assert seen["ldap-broken.xz"][:3] == ("unreadable", False, "unreadable") and seen["ldap-pretty.xz"] == ("ds389-json-pretty", True, None, "xz") and len(seen) == 9
    plan = E.read_events(spark, str(tmp_path / "slapd.log"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {r.server for r in E.read_events(spark, str(tmp_path / "ldap.xz"), server="dir3").collect()} == {"dir3"}


def test_leftovers_of_a_folder_are_no_logs(spark, tmp_path):
    body = "\n".join(stamped(OPENLDAP)) + "\n"
    for i, name in enumerate(["slapd.log", "slapd.log.1", "slapd.log.bak", "slapd.log~", "slapd.log.swp", ".slapd.log"]):
        (tmp_path / name).write_text(body)
        os.utime(tmp_path / name, (time.time() - 86_400 * (3 * i + 1),) * 2)
    names = lambda *args, **how: [f.rsplit("/", 1)[1] for f in L.list_files(spark, *args, **how)]
    folder = str(tmp_path)
    assert names(folder) == ["slapd.log", "slapd.log.1"]
    assert names(folder, mtime_days=2) == names(folder, max_files=1) == ["slapd.log"]
    assert names([folder, f"{folder}/slapd.log.bak"], max_files=1) == ["slapd.log", "slapd.log.bak"]
    assert E.read_events(spark, folder, max_files=1).count() == len(OPENLDAP)
    assert E.read_events(spark, f"{folder}/slapd.log~").count() == len(OPENLDAP)


def test_errors_logs(spark):
    ds = ["[05/Feb/2025:01:00:00.000000000 +0000] - ERR - backend - index of cn is broken", "and it was cn - again", "[05/Feb/2025:01:00:01.000000000 +0000] - ERR - changelog - cannot trim", "[05/Feb/2025:01:00:02.000000000 +0000] - INFO - slapd started."]
    e = E.parse_ds389_errors(as_lines(spark, ds))
    assert {(r.what, r.name): r.n for r in S.server_log_counts(e).collect()} == {("severity", "ERR"): 2, ("severity", "INFO"): 1, ("subsystem", "backend"): 1, ("subsystem", "changelog"): 1}
    assert e.where("kind = 'SERVER_LOG_CONT'").count() == 1
    dj = ["[05/Feb/2025:01:00:00 +0000] category=JEB severity=WARNING msgID=7 msg=cleaner is late", "java.lang.X: no", "\tat a.b.c", "\tat d.e.f", "[05/Feb/2025:01:00:05 +0000] category=SYNC severity=WARNING msgID=9 msg=severity=FATAL said the peer"]
    e = E.parse_opendj_errors(as_lines(spark, dj))
    assert {(r.what, r.name): r.n for r in S.server_log_counts(e).collect()} == {("severity", "WARNING"): 2, ("subsystem", "JEB"): 1, ("subsystem", "SYNC"): 1}
    assert e.where("kind = 'SERVER_LOG_CONT'").count() == 3


DJ = """[05/Feb/2025:09:15:00 -0500] CONNECT conn=77 from=203.0.113.9:40404 to=203.0.113.1:1636 protocol=LDAP
[05/Feb/2025:09:15:00 -0500] EXTENDED REQ conn=77 op=1 msgID=2 name="StartTLS" oid="1.3.6.1.4.1.1466.20037"
[05/Feb/2025:09:15:00 -0500] EXTENDED RES conn=77 op=1 msgID=2 name="StartTLS" oid="1.3.6.1.4.1.1466.20037" result=0 etime=3
[05/Feb/2025:09:15:01 -0500] BIND REQ conn=77 op=2 msgID=3 version=3 type=SIMPLE dn="uid=reader,o=lab"
[05/Feb/2025:09:15:01 -0500] BIND RES conn=77 op=2 msgID=3 result=0 authDN="uid=reader,o=lab" etime=40
[05/Feb/2025:09:15:02 -0500] MODIFY REQ conn=77 op=3 msgID=4 dn="cn=a b,o=lab"
[05/Feb/2025:09:15:03 -0500] MODIFY RES conn=77 op=3 msgID=4 result=50 msg="may not result=0 write" etime=250
[05/Feb/2025:09:15:04 -0500] SEARCH REQ conn=77 op=4 msgID=5 base="ou=rooms,o=lab" scope=subordinateSubtree filter="(floor>=3)" attrs="ALL"
[05/Feb/2025:09:15:05 -0500] SEARCH RES conn=77 op=4 msgID=5 result=0 nentries=12 etime=1210
[05/Feb/2025:09:15:06 -0500] DISCONNECT conn=77 reason="Idle Time Limit Exceeded\"""".split("\n")


def test_opendj(spark):
    e = E.parse_opendj(as_lines(spark, DJ))
    got = sorted(e.collect(), key=lambda r: r.ord.seq)
    assert [r.kind for r in got] == "ACCEPT EXT RESULT BIND RESULT MOD RESULT SRCH SEARCH_RESULT CLOSED".split()
    assert (got[0].src, got[6].err, got[7].scope, got[8].nentries, got[9].reason) == ("203.0.113.9:40404", 50, 3, 12, "Idle Time Limit Exceeded")
    ops = O.build_operations(e)
    # What stands behind msg= is all message, so that operation tells no time.
    assert S.account_stats(ops).where("account = 'uid=reader,o=lab'").first().etime_total == 1.25
    assert {(r.what, r.name): r.n for r in S.bind_usage(O.bind_usage_rows(e)).collect()} == {("method", "SIMPLE"): 1, ("transport", "ldap + StartTLS"): 1}
    ldaps = [DJ[0].replace("protocol=LDAP", "protocol=LDAPS"), DJ[3]]
    assert O.bind_usage_rows(E.parse_opendj(as_lines(spark, ldaps))).first().transport == "ldaps"


def test_files_are_read_named_and_chosen(spark, tmp_path):
    rows = "\n".join(stamped(OPENLDAP)) + "\n"
    (tmp_path / "slapd.log").write_text(rows.replace("\n", "\r\n"))
    with gzip.open(tmp_path / "slapd.log.gz", "wt") as f:
        f.write(rows)
    (tmp_path / "ldap-389.log").write_text("\n".join(DS389))
    (tmp_path / "ldap-dj.log").write_text("\n".join(DJ))
    (tmp_path / "ldap-note.log").write_text("hello\nworld\n")
    (tmp_path / "ldap.log.bak").write_text("x\n")
    (tmp_path / ".ldap.log").write_text("x\n")
    (tmp_path / "ldap-empty.log").write_text("")
    chosen = [r.path.rsplit("/", 1)[1] for r in L.select_inputs(spark, str(tmp_path)).collect()]
    assert chosen == ["ldap-389.log", "ldap-dj.log", "ldap-note.log", "slapd.log", "slapd.log.gz"]
    lines = L.read_lines(spark, [str(tmp_path / c) for c in chosen])
    kinds = L.select_run_kind(L.classify_files(lines))
    named = {r.file.rsplit("/", 1)[1]: (r.kind, r.kept, r.reason) for r in kinds.collect()}
    assert named["ldap-389.log"] == ("ds389-text", True, None) and named["ldap-dj.log"][0] == "opendj" and named["slapd.log.gz"][0] == "openldap"
    assert named["ldap-note.log"] == ("not-a-log", False, "not a log")
    events = E.parse_files(lines, kinds)
    assert events.count() == 2 * len(OPENLDAP) + len(DS389) + len(DJ) and events.where("kind = 'UNKNOWN_LINE'").count() == 3
    single = {r.file.rsplit("/", 1)[1]: r.kept for r in L.select_run_kind(L.classify_files(lines), single_kind=True).collect()}
    assert single == {"ldap-389.log": True, "ldap-dj.log": False, "ldap-note.log": False, "slapd.log": False, "slapd.log.gz": False}


def test_misnamed_compression(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(50_000))
    paths = []
    for name, opener in (("a.log_1", lzma.open), ("b.log_2", bz2.open), ("c.log_3", gzip.open), ("d.log_4", open)):
        paths.append(str(tmp_path / name))
        with opener(paths[-1], "wt") as f:
            f.write(text)
    df = L.read_compressed(spark, paths)
    assert [r.n for r in df.groupBy("file").agg(F.count("*").alias("n")).collect()] == [50_000] * 4
    assert df.where("raw <> concat('line ', ord.seq)").count() == 0


def test_order_of_lines_over_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"{i:07d} some text\n" for i in range(100_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = [r.raw for r in L.read_lines(spark, str(tmp_path / "big.log")).orderBy("ord").select("raw").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == sorted(rows) and len(rows) == 100_000


@pytest.mark.parametrize(
    ("raw", "template"),
    [
        ("(|(uid=a)(uid=b)(uid=c))", "(|(uid=$)+)"), ("(&(objectclass=person)(uid=abc))", "(&(objectclass=$)(uid=$))"), ("(uid=*)", "(uid=*)"), ("(employeenumber=100*)", "(employeenumber=#*)"),
        ("(uid = foo)", "(uid=$)"), ("(uid=u12)", "(uid=$#)"), ("(!(a=1))", "(!(a=#))"), ("(&(|(a=1)(a=2))(|(a=3)(a=4)(a=5)))", "(&(|(a=#)+)+)"), ('(uid=x)" attrs="cn', "(uid=$)"), ("(a>=5)", "(a>=#)"), ("", ""), ("((a=1)", "((a=#)"),
    ],
)
def test_templates(raw, template):
    assert filters.generalize(raw) == template


def test_code_tables(spark):
    assert len(codes.RESULT_CODES) == 39 and len(codes.EXT_OIDS) == 4
    df = spark.createDataFrame([(c,) for c in (0, 5, 49, 3, 50, 80, 99, None)], "c int")
    got = df.select(codes.result_code_class(F.col("c")).alias("k"), codes.is_error(F.col("c")).alias("e"), codes.result_code_name(F.col("c")).alias("n")).collect()
    assert [r.k for r in got] == ["informational", "informational", "client", "policy", "policy-or-client", "server", "server", None]
    assert [r.e for r in got] == [False, False, True, True, True, True, True, None] and got[6].n == "unknown"
    bins = spark.createDataFrame([(0.0,), (0.02,), (0.2,), (3.0,), (1e9,)], "x double")
    assert [r.b for r in bins.select(codes.etime_log_bin(F.col("x")).alias("b")).collect()] == [0, 6, 11, 17, 34]
    assert [r.b for r in bins.select(codes.etime_bucket(F.col("x")).alias("b")).collect()] == [0, 1, 1, 2, 10]
    assert spark.range(1).select(codes.log_bin_label(F.lit(0)).alias("a"), codes.log_bin_label(F.lit(15)).alias("b"), codes.log_bin_label(F.lit(34)).alias("c")).first()[:] == ("1 µs", "1 ms", "6.31 s")


def test_names(spark):
    df = spark.createDataFrame([("web a=1 b=2", "192.0.2.1:33 (x)", "uid=a,dc=b")], "n string, a string, d string")
    got = df.select(filters.session_name_key(F.col("n")), filters.nat_host_key(F.col("a")), filters.short_account(F.col("d"))).first()
    assert got[:] == ("web", "192.0.2.1", "uid=a")


def test_register_dialect(spark):
    E.register_dialect("toy", lambda lines: E.as_events(lines, {"kind": F.lit("TITLE")}))
    lines = as_lines(spark, ["x"])
    assert E.parse_files(lines, spark.createDataFrame([("f", "toy", True)], "file string, kind string, kept boolean")).first().kind == "TITLE"
    del E.PARSERS["toy"]
