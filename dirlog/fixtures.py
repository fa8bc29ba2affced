"""The events table as logs of every dialect: the same facts as text, for end-to-end checks and the bench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render_openldap(events: DataFrame, header: str = "rfc3339-utc") -> DataFrame:
    """(file, ord, raw): connection, bind, one operation for each event, unbind and close of each user.

    events: event_id, ts, user_id, event_type, value, props. ``header`` is rfc3339-utc or syslog.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.select("event_id", "ts", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), k.alias("k"))
    if header == "syslog":
        stamp = F.concat(F.date_format("ts", "MMM"), F.lpad(F.dayofmonth("ts").cast("string"), 3, " "), F.date_format("ts", " HH:mm:ss"))
    else:
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.concat(stamp, F.lit(" ldap"), (F.col("user_id") % 3 + 1).cast("string"), F.lit(" slapd[100]: conn="), F.col("user_id").cast("string"))
    op = F.concat(F.lit(" op="), (F.col("event_id") + 1).cast("string"), F.lit(" "))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    kind, n = F.col("event_type"), F.col("k").cast("string")
    person = text('dn="uid=u', n, ',ou=people,dc=example,dc=com"')
    request = (
        F.when(kind == "click", text('SRCH base="ou=people,dc=example,dc=com" scope=2 deref=0 filter="(uid=u', n, ')"'))
        .when(kind == "view", text('SRCH base="ou=groups,dc=example,dc=com" scope=1 deref=0 filter="(cn=*g', n, '*)"'))
        .when(kind == "error", text('SRCH base="cn=config" scope=0 deref=0 filter="(employeeNumber=', n, '*)"'))
        .when(kind == "purchase", text("MOD ", person))
        .otherwise(text("ADD ", person))
    )
    which = (F.col("k") % 4 + 1).cast("int")
    code = F.when(kind == "error", F.element_at(F.array(*map(F.lit, (32, 49, 50, 53))), which)).otherwise(0)
    name = F.when(kind == "error", F.element_at(F.array(*map(F.lit, ("noSuchObject", "invalidCredentials", "insufficientAccessRights", "unwillingToPerform"))), which)).otherwise("")
    times = text(" err=", code.cast("string"), " qtime=0 etime=", F.col("value").cast("string"))
    entries = F.when(kind == "error", "0").otherwise(n)
    searched = kind.isin("click", "view", "error")
    result = F.when(searched, text("SEARCH RESULT tag=101", times, " nentries=", entries, " text=", name)).otherwise(text("RESULT tag=", F.when(kind == "purchase", "103").otherwise("105"), times, " text=", name))
    line = lambda phase, c: F.struct(F.lit(phase).cast("bigint").alias("seq"), c.alias("raw"))
    each = e.select("event_id", F.explode(F.array(line(0, text(head, op, request)), line(1, text(head, op, result)))).alias("l"))

    ends = e.groupBy("user_id").agg(F.min_by(F.struct("event_id", "ts"), "event_id").alias("first"), F.max_by(F.struct("event_id", "ts"), "event_id").alias("last"))
    user = F.col("user_id").cast("string")
    opened = text(head, " fd=12 ACCEPT from IP=192.0.2.", (F.col("user_id") % 250).cast("string"), ":", (F.col("user_id") + 40000).cast("string"), " (IP=0.0.0.0:389)")
    bind = text(head, ' op=0 BIND dn="uid=u', user, ',ou=apps,dc=example,dc=com" method=128')
    bound = text(head, " op=0 RESULT tag=97 err=0 qtime=0 etime=0.00 text=")
    start = ends.select("user_id", "first.*").select("event_id", F.explode(F.array(line(-3, opened), line(-2, bind), line(-1, bound))).alias("l"))
    closing = text(head, " op=", (F.col("event_id") + 2).cast("string"), " UNBIND")
    end = ends.select("user_id", "last.*").select("event_id", F.explode(F.array(line(2, closing), line(3, text(head, " fd=12 closed")))).alias("l"))
    return each.union(start).union(end).select(F.lit("rendered").alias("file"), place(F.col("event_id"), F.col("l.seq")).alias("ord"), F.col("l.raw").alias("raw"))


#: Events whose lines make a block of the rendered file, and places that an event has for lines.
BLOCK, PLACES = 1000, 100


def place(event: Column, phase: Column) -> Column:
    """The order key of an event's line: as of a file that was read in splits."""
    return F.struct((F.floor(event / BLOCK)).cast("bigint").alias("block"), (F.pmod(event, F.lit(BLOCK)) * PLACES + phase + PLACES // 2).cast("bigint").alias("seq"))


def event_of(ord: Column) -> Column:
    return ord["block"] * BLOCK + F.floor(ord["seq"] / PLACES)


def phase_of(ord: Column) -> Column:
    return F.pmod(ord["seq"], F.lit(PLACES)) - PLACES // 2


def text(*parts: str | Column | int) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def facts(events: DataFrame) -> DataFrame:
    """(event_id, ts, user_id, event_type, value, k, is_first, is_last): an event and whether it is its user's first or last."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    e = events.select("event_id", "ts", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), k)
    ends = e.groupBy("user_id").agg(F.min("event_id").alias("_a"), F.max("event_id").alias("_b"))
    return e.join(ends, "user_id").withColumns({"is_first": F.col("event_id") == F.col("_a"), "is_last": F.col("event_id") == F.col("_b")}).drop("_a", "_b")


def rendered(e: DataFrame, file: Column, head: Column, lines: list[tuple[int, Column, Column]]) -> DataFrame:
    """(file, ord, raw) of (phase, condition, payload) of each event."""
    each = F.array(*[F.when(on, F.struct(F.lit(phase).alias("p"), F.concat(head, payload).alias("raw"))) for phase, on, payload in lines])
    rows = e.select("event_id", file.alias("file"), F.explode(F.array_compact(each)).alias("l"))
    return rows.select("file", place(F.col("event_id"), F.col("l.p")).alias("ord"), "l.raw")


def render_cluster(events: DataFrame) -> DataFrame:
    """(file, ord, raw): an OpenLDAP cluster with sessions, paged searches, restarts, all kinds of operations and notes.

    Users of a remainder of 0 or 1 by 4 are bound by name (those of 1 with a mechanism), of 2 with an empty name, of 3 anonymously.
    """
    e = facts(events)
    k, u, kind, first, last = F.col("k"), F.col("user_id"), F.col("event_type"), F.col("is_first"), F.col("is_last")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = text(stamp, " ldap", u % 3 + 1, " slapd[7]: ")
    conn, op = text("conn=", u), text("conn=", u, " op=", F.col("event_id") + 1, " ")
    who = text('dn="uid=u', u, ',ou=apps,dc=example,dc=com"')
    person = text('dn="uid=u', k, ',ou=people,dc=example,dc=com"')
    times = text(" qtime=0.01 etime=", F.col("value"))
    bound, block, at = u % 4 < 2, F.floor(F.col("event_id") / BLOCK), F.pmod(F.col("event_id"), F.lit(BLOCK))
    session = F.when((u % 4 < 2) & (k % 4 == 0), text("[IP=198.51.100.", u % 50, " NAME=app", u % 7, " pid=", k, " USERNAME=user", u % 11, "] ")).otherwise("")
    oid = F.element_at(F.array(*map(F.lit, ("1.3.6.1.4.1.1466.20037", "1.3.6.1.4.1.4203.1.11.1", "1.3.6.1.4.1.4203.1.11.3", "1.3.6.1.1.8", "1.2.3.4"))), (k % 5 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, (50, 3, 80))), (k % 3 + 1).cast("int"))
    click, view, error, bought, signed = (kind == n for n in ("click", "view", "error", "purchase", "signup"))
    other = lambda n: error & (k % 5 == n)
    page = lambda n: text(conn, " op=", 900_000_010 + n, " ")
    lines = [
        (-40, at == 0, text("slapd starting")), (-39, F.col("event_id") == 0, text("@(#) $OpenLDAP: slapd 2.6.7 (Jan 12 2026 10:00:00) $")),
        (-30, (at == 600) & (block % 2 == 0), text("daemon: shutdown requested and initiated.")), (-30, (at == 601) & (block % 2 == 0), text("slapd stopped.")),
        (-20, first, text(conn, " fd=9 ACCEPT from IP=203.0.113.", u % 200, ":", u + 1024, " (IP=0.0.0.0:389)")), (-19, first & (u % 5 == 1), text(conn, " op=900000000 STARTTLS")), (-18, first & (u % 5 < 2), text(conn, " fd=9 TLS established tls_ssf=256 ssf=256")),
        (-17, first & bound, text(conn, " op=0 BIND ", who, " method=128")), (-17, first & (u % 4 == 2), text(conn, ' op=0 BIND dn="" method=128')), (-17, first & (u % 4 == 3), text(conn, " op=0 BIND anonymous mech=implicit bind_ssf=0 ssf=0")),
        (-16, first & (u % 4 == 1), text(conn, " op=0 BIND ", who, " mech=SCRAM-SHA-256 bind_ssf=0 ssf=0")), (-15, first, text(conn, " op=0 RESULT tag=97 err=0 qtime=0 etime=0.00 text=")),
        (-2, click & (k % 4 == 1), text('=> get_ctrls: oid="1.2.840.113556.1.4.319" (critical)')), (-2, view & (k % 10 == 0), text("<= mdb_substring_candidates: (cn) not indexed")),
        (0, click, text(op, session, 'SRCH base="ou=people,dc=example,dc=com" scope=2 deref=0 filter="(uid=u', k, ')"')), (1, click, text(op, "SRCH attr=CN mail")),
        (0, view, text(op, 'SRCH base="ou=groups,dc=example,dc=com" scope=1 deref=0 filter="(&(?group=g', k, ')(cn=x))"')), (2, click | view, text(op, "SEARCH RESULT tag=101 err=0", times, " nentries=", k, " text=")),
        (0, other(0), text(op, "CMP ", person, ' attr="mail"')), (2, other(0), text(op, "RESULT tag=111 err=6", times, " text=")), (0, other(1), text(op, "DEL ", person)), (2, other(1), text(op, "RESULT tag=107 err=32", times, " text=gone")),
        (0, other(2), text(op, "MODRDN ", person)), (2, other(2), text(op, "RESULT tag=109 err=68", times, " text=there")), (0, other(3), text(op, "EXT oid=", oid)), (2, other(3), text(op, "RESULT oid= err=0", times, " text=")), (0, other(4), text(op, "ABANDON msg=", k)),
        (-1, bought, F.element_at(F.array(text("slap_get_csn: conn=", u, " op=1 generated new csn=20260101000000.000000Z#000000#001#000000 manage=1"), text("slap_queue_csn: queueing 0x7f 20260101000000.000000Z#000000#001#000000"), text("slap_graduate_commit_csn: removing 0x7f 20260101000000.000000Z#000000#001#000000")), (k % 3 + 1).cast("int"))),
        (0, bought, text(op, "MOD ", person)), (1, bought, text(op, "MOD attr=mail Phone")), (2, bought, text(op, "RESULT tag=103 err=0", times, " text=")),
        (0, signed, text(op, "ADD ", person)), (2, signed & (k % 5 > 0), text(op, "RESULT tag=105 err=", code, times, " text=no ", k % 2)),
        (5, k == 7, text("connection_input: conn=", u, " deferring operation: too many executing")), (5, k == 8, text('critical control "1.2.3" not supported; stripped.')), (5, k == 9, text("slap_global_control: unrecognized control: oid=1.2.3.9")), (5, k == 10, text("what is this ", u % 3)),
        *[x for n, found in enumerate((100, 100, 7)) for x in ((10 + 2 * n, last, text(page(n), 'SRCH base="dc=example,dc=com" scope=2 deref=0 filter="(paged=*)"')), (11 + 2 * n, last, text(page(n), "SEARCH RESULT tag=101 err=0 qtime=0 etime=0.00 nentries=", found, " text=")))],
        (20, last, text(conn, " op=900000009 UNBIND")), (21, last, text(conn, " fd=9 closed (connection lost)")),
    ]
    return rendered(e, text("f", u % 2), head, lines)


#: How bracketed times are written.
BRACKETED = "dd/MMM/yyyy:HH:mm:ss"


def render_ds389(events: DataFrame, json: bool = False) -> DataFrame:
    """(file, ord, raw): the same users and events as a 389-ds access log, as text or as JSON objects."""
    e = facts(events)
    k, u, kind, first, last = F.col("k"), F.col("user_id"), F.col("event_type"), F.col("is_first"), F.col("is_last")
    etime, op = text(F.col("value")), F.col("event_id") + 1
    who, person, host = text("uid=u", u, ",ou=apps,dc=example,dc=com"), text("uid=u", k, ",ou=people,dc=example,dc=com"), text("192.0.2.", u % 250)
    click, view, error, bought, signed = (kind == n for n in ("click", "view", "error", "purchase", "signup"))
    search, notes, sasl = click | view, view & (k % 10 == 0), u % 4 == 1
    base, scope = F.when(click, "ou=people,dc=example,dc=com").otherwise("ou=groups,dc=example,dc=com"), F.when(click, 2).otherwise(1)
    flt, tag, err = F.when(click, text("(uid=u", k, ")")).otherwise(text("(cn=*g", k, "*)")), F.when(search, 101).otherwise(103), F.when(error, 32).otherwise(0)
    if json:
        time = text('{"local_time":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '000 +0000","operation":"')
        line = lambda name, *more: text(name, '","conn_id":', u, *more, "}")
        own = text(',"op_id":', op)
        verb = F.when(error, "COMPARE").when(bought, "MODIFY").otherwise("ADD")
        lines = [
            (-20, first, line("CONNECTION", ',"fd":7,"client_ip":"', host, '"')), (-19, first, line("BIND", ',"op_id":0,"bind_dn":"', who, '","method":"', F.when(sasl, "sasl").otherwise("128"), '"')), (-18, first, line("RESULT", ',"op_id":0,"tag":97,"err":0,"nentries":0,"wqtime":"0.1","etime":"0.00"')),
            (0, search, line("SEARCH", own, ',"base_dn":"', base, '","scope":', scope, ',"filter":"', flt, '","attrs":["cn","mail"]')), (0, ~search, line(verb, own, ',"target_dn":"', person, '"')),
            (1, F.lit(True), line("RESULT", own, ',"tag":', tag, ',"err":', err, ',"nentries":', k, ',"etime":"', etime, '"', F.when(notes, ',"notes":[{"note":"U"}]').otherwise(""))),
            (20, last, line("UNBIND", ',"op_id":900000009')), (21, last, line("DISCONNECT", ',"op_id":-1,"fd":7,"close_reason":"B1"')),
        ]
        return rendered(e, F.lit("ds389.json"), time, lines)
    time = text("[", F.date_format("ts", f"{BRACKETED}.SSSSSS"), "000 +0000] ")
    conn = text("conn=", u)
    at = text(conn, " op=", op, " ")
    verb = F.when(error, text("CMP ", 'dn="', person, '" attr="mail"')).when(bought, text('MOD dn="', person, '"')).otherwise(text('ADD dn="', person, '"'))
    lines = [
        (-20, first, text(conn, " fd=7 slot=3 connection from ", host, " to 192.0.2.251")), (-19, first, text(conn, ' op=0 BIND dn="', who, '" method=', F.when(sasl, 'sasl version=3 mech="GSSAPI"').otherwise("128 version=3"))), (-18, first, text(conn, " op=0 RESULT err=0 tag=97 nentries=0 wqtime=0.100000000 etime=0.00")),
        (0, search, text(at, 'SRCH base="', base, '" scope=', scope, ' filter="', flt, '" attrs="cn mail"')), (0, ~search, text(at, verb)), (1, F.lit(True), text(at, "RESULT err=", err, " tag=", tag, " nentries=", k, " wqtime=0.000100000 etime=", etime, F.when(notes, " notes=U").otherwise(""))),
        (2, k == 5, text("conn=Internal(", u, ") op=", op, '(1)(1) SRCH base="cn=config" scope=0 filter="(objectclass=*)" attrs=ALL')), (20, last, text(conn, " op=900000009 UNBIND")), (21, last, text(conn, " op=-1 fd=7 Disconnect - Cleanly Closed Connection - U1")),
    ]
    title = e.where("event_id = 0").select(F.lit("ds389.log").alias("file"), place(F.col("event_id"), F.lit(-45)).alias("ord"), F.lit("\t389-Directory/3.0.1 B2026.007.1200").alias("raw"))
    return rendered(e, F.lit("ds389.log"), time, lines).union(title)


def render_opendj(events: DataFrame) -> DataFrame:
    """(file, ord, raw): the same users and events as an OpenDJ access log; times spent in whole milliseconds."""
    e = facts(events)
    k, u, kind, first, last = F.col("k"), F.col("user_id"), F.col("event_type"), F.col("is_first"), F.col("is_last")
    time, conn = text("[", F.date_format("ts", BRACKETED), " +0000] "), text("conn=", u)
    ms, ids = (F.col("value") * 1000).cast("long"), text(" conn=", u, " op=", F.col("event_id") + 1, " msgID=", F.col("event_id") + 2)
    who, person = text('dn="uid=u', u, ',ou=apps,dc=example,dc=com"'), text('dn="uid=u', k, ',ou=people,dc=example,dc=com"')
    search = kind.isin("click", "view")
    verb = F.when(search, "SEARCH").when(kind == "error", "COMPARE").when(kind == "purchase", "MODIFY").otherwise("ADD")
    more = F.when(search, text(' base="ou=people,dc=example,dc=com" scope=', F.when(kind == "click", "wholeSubtree").otherwise("singleLevel"), ' filter="(uid=u', k, ')" attrs="cn"')).otherwise(text(" ", person))
    tls = text(" ", conn, ' op=900000001 msgID=1 name="StartTLS" oid="1.3.6.1.4.1.1466.20037"')
    lines = [
        (-20, first, text("CONNECT ", conn, " from=192.0.2.", u % 250, ":", u + 1024, " to=192.0.2.251:1389 protocol=", F.when(u % 5 == 0, "LDAPS").otherwise("LDAP"))), (-19, first & (u % 5 == 1), text("EXTENDED REQ", tls)), (-18, first & (u % 5 == 1), text("EXTENDED RES", tls, " result=0 etime=0")),
        (-17, first, text("BIND REQ ", conn, " op=0 msgID=2 version=3 type=", F.when(u % 4 == 1, "SASL").otherwise("SIMPLE"), " ", who)), (-16, first, text("BIND RES ", conn, " op=0 msgID=2 result=0 etime=0")),
        (0, F.lit(True), text(verb, " REQ", ids, more)), (1, F.lit(True), text(verb, " RES", ids, " result=", F.when(kind == "error", 32).otherwise(0), F.when(search, text(" nentries=", k)).otherwise(""), " etime=", ms, F.when(kind == "error", ' msg="no such thing etime=5"').otherwise(""))),
        (20, last, text("UNBIND REQ ", conn, " op=900000009 msgID=9")), (21, last, text("DISCONNECT ", conn, ' reason="Client Unbind"')),
    ]
    return rendered(e, F.lit("opendj.log"), time, lines)


def render_errors(events: DataFrame, dialect: str) -> DataFrame:
    """(file, ord, raw): every error and signup as an entry of a 389-ds (text or json) or OpenDJ errors log, with a second line for some."""
    e = facts(events.where("event_type in ('error', 'signup')"))
    k, error = F.col("k"), F.col("event_type") == "error"
    level, part = F.when(error, F.when(k % 2 == 0, "ERR").otherwise("WARNING")).otherwise("NOTICE"), text("part", k % 5)
    if dialect == "json":
        time = text('{"local_time":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '000 +0000","severity":"')
        return rendered(e, F.lit("errors.json"), time, [(0, F.lit(True), text(level, '","subsystem":"', part, '","msg":"said ', k, '"}'))])
    stamp = text("[", F.date_format("ts", BRACKETED + (".SSSSSS" if dialect == "ds389" else "")), "000" if dialect == "ds389" else "", " +0000] ")
    entry = text(stamp, "- ", level, " - ", part, " - said ", k) if dialect == "ds389" else text(stamp, "category=", part, " severity=", level, " msgID=", k, " msg=said severity=none")
    return rendered(e, F.lit(f"errors.{dialect}"), F.lit(""), [(0, F.lit(True), entry), (1, k % 10 == 0, text("and went on"))])


def render_shapes(events: DataFrame) -> DataFrame:
    """(file, ord, raw): one line an event, its header in one of five shapes by the event's number, three hours east of UTC where it says so."""
    e = facts(events)
    which = F.col("event_id") % 5
    nanos, hexed = F.unix_micros("ts") % 1_000_000 * 1000, lambda c: F.lower(F.hex(c))
    head = (
        F.when(which == 0, text(hexed(F.unix_seconds("ts")), ".", F.lpad(hexed(nanos), 8, "0"), " 0x7f9c1e33a700 "))
        .when(which == 1, text("[", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "] "))
        .when(which == 2, text(F.date_format(F.col("ts") + F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "+03:00 east slapd[9]: "))
        .when(which == 3, text(F.date_format("ts", "MMM"), F.lpad(F.dayofmonth("ts").cast("string"), 3, " "), F.date_format("ts", " HH:mm:ss"), " plain slapd[9]: "))
        .otherwise(text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), " west slapd[9]: "))
    )
    return rendered(e, F.lit("shapes"), head, [(0, F.lit(True), text("conn=", F.col("user_id"), " op=", F.col("event_id"), " UNBIND"))])
