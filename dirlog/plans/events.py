"""Lines of every dialect as rows of the canonical event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlog.functions import timestamps as T
from dirlog.schema import EVENT_FIELDS
from dirlog.sources.lines import LINES, as_records, inspect_files, list_files, read_ds389_json, read_files

Parser = Callable[..., DataFrame]


def grab(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def number(c: Column, key: str, kind: str = "int") -> Column:
    """The value of key=value as a number; null where it is missing or none."""
    return grab(c, rf"(?:^|[\s,]){key}=\"?(-?[\d.]+)").try_cast(kind)


def quoted(c: Column, key: str) -> Column:
    """The value of key="..." or key=word."""
    return F.coalesce(grab(c, rf'(?:^|\s){key}="([^"]*)"'), grab(c, rf'(?:^|\s){key}=([^\s"]\S*)'))


def as_events(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The canonical columns of ``df``: those given, those that are there, null for the others."""
    out = []
    for name, kind in EVENT_FIELDS:
        c = fields.get(name, F.col(name) if name in df.columns else F.lit(None))
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns worked out here, once a row.

    A filter on a column that is made of long expressions would otherwise be pushed down with all of them
    written out, again at every use; rows that a generator returns are a border that it cannot pass.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(F.array(F.struct(*columns))).alias("_s")).select(*others, "_s.*")


# ----- OpenLDAP -----

FORMATS = ("debug", "syslog", "syslog-utc", "syslog-localtime", "rfc3339-utc", "rfc3339", "ol26")
HEADERS = ("debug", "syslog", "rfc3339-utc", "rfc3339", "ol26")
MARK = "\x01"

def groups(c: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that spans the text, from one match: an array of n strings, or of one where it does not fit."""
    return F.split(F.regexp_replace(c, pattern, MARK.join(f"${i}" for i in range(1, n + 1)) + MARK), MARK)


def group(name: str, i: int) -> Column:
    """The i-th of ``groups``; null if empty or not there."""
    return F.when(F.size(name) > 1, F.nullif(F.get(F.col(name), i - 1), F.lit("")))


def parse_header(lines: DataFrame, fmt: str = "auto", year: int | None = None, tz: str = "UTC") -> DataFrame:
    """Adds format, ts_text, server, proc, payload and ts_ns; payload is null where no header (or not ``fmt``) fits.

    ``year`` stands in for the one that syslog times lack: the current year if none is given.
    """
    if fmt != "auto" and fmt not in FORMATS:
        raise ValueError(f"unknown header format {fmt!r}")
    year = year if year is not None else lines.sparkSession.sql("SELECT year(current_date())").first()[0]
    raw = F.col("raw")
    # What stands at fixed places of a line says its shape, and so where its time ends; then come host and process, but for two shapes.
    at = lambda c, i: F.substring(c, i, 1)
    shape = F.when((at(raw, 5) == "-") & (at(raw, 11) == "T"), "rfc3339").when((at(raw, 4) == " ") & (at(raw, 10) == ":"), "syslog").when(raw.startswith("[") & (at(raw, 12) == "T"), "ol26")
    df = lines.withColumn("shape", shape.when(raw.contains(" 0x") & raw.rlike(r"^[0-9a-f]+[.][0-9a-f]+ +0x"), "debug"))
    cut = F.when(F.col("shape") == "syslog", 15).when(F.col("shape") == "ol26", F.instr(raw, "]")).otherwise(F.instr(raw, " ") - 1)
    # Each step is a column of its own, so that what several steps use is worked out once.
    df = df.withColumn("cut", cut)
    df = df.withColumns({"stamp": F.substring(raw, F.lit(1), F.col("cut")), "after": F.ltrim(F.substring(raw, F.col("cut") + 1, F.length(raw)))})
    stamp, after = F.col("stamp"), F.col("after")
    named = F.col("shape").isin("rfc3339", "syslog")
    df = df.withColumn("host", F.when(named, F.substring_index(after, " ", 1))).withColumn("colon", F.instr(after, ": "))
    host, colon = F.col("host"), F.col("colon")
    df = df.withColumn("process", F.when(named & (colon > F.length(host) + 2), F.ltrim(F.substring(after, F.length(host) + 2, colon - F.length(host) - 2))))
    whole = ~named | ((host != "") & (F.col("process") != "") & ~F.col("process").contains(" "))
    rest = F.when(named, F.substring(after, colon + 1, F.length(after))).when(F.col("shape") == "debug", F.substring(after, F.instr(after, " ") + 1, F.length(after))).otherwise(after)
    found = F.when(whole, F.when((F.col("shape") == "rfc3339") & stamp.endswith("Z") & stamp.contains("."), "rfc3339-utc").otherwise(F.col("shape")))
    if fmt.startswith("syslog-"):
        found = F.when(found == "syslog", fmt)
    elif fmt == "rfc3339":
        found = F.when(found.startswith("rfc3339"), fmt)
    elif fmt != "auto":
        found = F.when(found == fmt, fmt)
    df = df.withColumns({"format": found, "payload": F.ltrim(rest)})
    own = lambda c: F.when(F.col("format").isNotNull(), c)
    ts_text = F.when(F.col("shape") == "ol26", F.translate(stamp, "[]", "")).otherwise(stamp)
    df = df.withColumns({"ts_text": own(ts_text), "server": own(host), "proc": own(F.col("process")), "payload": own(F.col("payload"))})
    return df.withColumn("ts_ns", T.to_epoch_ns(F.col("ts_text"), F.col("format"), year, tz, HEADERS if fmt == "auto" else (fmt,))).drop("shape", "cut", "stamp", "after", "host", "colon", "process")


def openldap_kind(p: Column, rest: Column) -> Column:
    """The kind of an OpenLDAP payload; ``rest`` is what follows conn= and op=."""
    n = F.when((rest.startswith("RESULT tag=") | rest.startswith("RESULT oid=")), "RESULT").when(rest.startswith("SEARCH RESULT "), "SEARCH_RESULT")
    n = n.when(rest.startswith("SRCH attr="), "SRCH_ATTR").when(rest.startswith("SRCH base="), "SRCH")
    n = n.when(rest.startswith("BIND authcid="), "BIND_AUTH").when(rest.startswith("BIND anonymous"), "BIND_ANON")
    n = n.when((rest.startswith("BIND dn=") & rest.contains('" mech=')), "BIND_DN_INFO").when(rest.startswith("BIND dn="), "BIND")
    n = n.when(((rest == "UNBIND") | rest.startswith("UNBIND ")), "UNBIND").when((rest.startswith("MOD dn=") | rest.startswith("MOD attr")), "MOD").when(rest.startswith("ADD dn="), "ADD")
    n = n.when(rest.startswith("DEL dn="), "DEL").when(rest.startswith("MODRDN dn="), "MODRDN").when(rest.startswith("CMP dn="), "CMP")
    n = n.when(rest.startswith("ABANDON msg"), "ABANDON").when(rest.startswith("EXT oid="), "EXT").when(rest == "STARTTLS", "STARTTLS").when(rest.startswith("TRACK "), "TRACK")
    c = F.when(p.rlike(r"^conn=\d+ fd=\d+ ACCEPT from (?:IP|PATH)="), "ACCEPT").when(p.rlike(r"(?i)^conn=\d+ fd=\d+ closed\b"), "CLOSED")
    c = c.when(p.rlike(r"(?i)^conn=\d+ fd=\d+ TLS established"), "TLS")
    g = F.when(p.startswith("SASL ["), "SASL").when(p.startswith("slap_get_csn:"), "CSN_GET").when(p.startswith("slap_queue_csn:"), "CSN_QUEUE")
    g = g.when(p.startswith("slap_graduate_commit_csn:"), "CSN_GRADUATE").when(p.contains("slap_global_control: unrecognized control:"), "GLOBAL_CONTROL")
    g = g.when(p.rlike(r"^(?:syncprov_|do_syncrep|syncrepl)"), "SYNCPROV").when(p.rlike(r"^=>\s+get_ctrls:"), "GET_CTRLS")
    g = g.when(p.rlike(r"(?i)(?:^|, |^<= )(?:mdb|bdb)_[a-z_]+: .*not indexed"), "NOT_INDEXED")
    g = g.when(p.rlike(r'^(?:critical|non-critical) control ".*" not supported'), "CONTROL_NOT_SUPPORTED").when(p.startswith("connection_input:"), "CONN_DEFER")
    g = g.when(p.rlike(r"^do_bind:\s+invalid\s+dn"), "DO_BIND_INVALID").when(p.startswith("ldap_back_dobind_int:"), "LDAP_BACK_DOBINT").when(p.startswith("ldap_back_retry:"), "LDAP_BACK_RETRY")
    g = g.when(p == "slapd starting", "SLAPD_STARTING").when(p == "slapd stopped.", "SLAPD_STOPPED").when(p.startswith("slapd shutdown:"), "SLAPD_SHUTDOWN").when(p.startswith("daemon: shutdown requested"), "DAEMON_SHUTDOWN")
    g = g.when(p.contains("$OpenLDAP: "), "VERSION")
    return F.when(rest.isNotNull(), F.coalesce(n, g, F.lit("UNKNOWN_LINE"))).when(p.startswith("conn="), F.coalesce(c, F.lit("UNKNOWN_LINE"))).otherwise(F.coalesce(g, F.lit("UNKNOWN_LINE")))


def parse_track(c: Column) -> Column:
    """k=v, k=v as a map; parts without = are dropped, the last of equal keys counts."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.contains("="))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.when(c.isNotNull(), F.map_from_entries(last))


def parse_openldap(lines: DataFrame, fmt: str = "auto", year: int | None = None, tz: str = "UTC") -> DataFrame:
    """OpenLDAP lines as events. Fields are only looked for in kinds that have them."""
    df = parse_header(lines, fmt, year, tz)
    p = F.col("payload")
    # "conn=N op=M what", word by word; in other lines one or both of the numbers stand elsewhere.
    df = df.withColumn("first", F.substring_index(p, " ", 1))
    df = df.withColumn("after", F.ltrim(F.substring(p, F.length("first") + 1, F.length(p))))
    df = df.withColumn("second", F.substring_index("after", " ", 1))
    number_of = lambda c, key: F.when(F.col(c).startswith(f"{key}="), F.rtrim(F.substring(c, len(key) + 2, 24), F.lit(":")).try_cast("bigint"))
    df = df.withColumns({"conn": number_of("first", "conn"), "op": number_of("second", "op")})
    rest = F.when(F.col("conn").isNotNull() & F.col("op").isNotNull(), F.ltrim(F.substring("after", F.length("second") + 1, F.length("after"))))
    anywhere = lambda key: F.when(F.col("rest").isNull() & p.contains(f"{key}="), grab(p, rf"\b{key}=(-?\d+)").try_cast("bigint"))
    df = df.withColumn("rest", F.when(rest.startswith(":"), F.ltrim(F.substring(rest, F.lit(2), F.length(rest)))).otherwise(rest)).drop("first", "after", "second")
    df = df.withColumns({"conn": F.coalesce("conn", anywhere("conn")), "op": F.coalesce("op", anywhere("op"))})
    has = F.col("rest").startswith("[IP=")
    df = df.withColumn("block", F.when(has, groups(F.col("rest"), r"^\[IP=(\S+)\s+NAME=(.*?)(?:\s+USERNAME=([^\]]*))?\]\s+(.*)$", 4)))
    df = df.withColumn("rest", F.coalesce(group("block", 4), F.col("rest")))
    df = df.withColumn("kind", F.when(p.isNull(), "UNKNOWN_LINE").otherwise(openldap_kind(p, F.col("rest"))))
    df = settled(df, "format", "ts_text", "ts_ns", "server", "proc", "payload", "conn", "op", "block", "rest", "kind")
    k, r = F.col("kind"), F.col("rest")
    only = lambda kinds, c: F.when(k.isin(*kinds), c)
    results, binds = ("RESULT", "SEARCH_RESULT"), ("BIND", "BIND_DN_INFO")
    df = df.withColumns({
        "res": only(results, groups(r, r"^(?:SEARCH )?RESULT\s+(?:tag=(\d+)|oid=(\S*))\s+err=(\d+)(?:\s+qtime=([\d.]+))?(?:\s+etime=([\d.]+))?(?:\s+nentries=(\d+))?(?:\s+text=(.*))?$", 7)),
        "srch": F.when(k == "SRCH", groups(r, r'^SRCH\s+base=(?:"([^"]*)"|(\S+))\s+scope=(\d+)\s+deref=(\d+)\s+filter=(.+)$', 5)),
        "track": F.when(k == "TRACK", parse_track(grab(r, r"^TRACK\s+(.*)$"))),
    })
    note = lambda kinds, pattern: only(kinds, grab(p, pattern))
    fields = {
        "ts": T.to_ts(F.col("ts_ns")),
        "fd": note(("ACCEPT", "CLOSED", "TLS"), r"\bfd=(\d+)").try_cast("int"),
        "src": note(("ACCEPT",), r"ACCEPT from (?:IP|PATH)=(\S+)"),
        "reason": F.coalesce(note(("CLOSED",), r"(?i)closed\s*\(?(.*?)\)?$"), note(("CONN_DEFER",), r"deferring operation: (.*)$")),
        "tag": group("res", 1).try_cast("int"), "err": group("res", 3).try_cast("int"), "qtime": group("res", 4).try_cast("double"), "etime": group("res", 5).try_cast("double"), "nentries": group("res", 6).try_cast("int"),
        "text": F.coalesce(group("res", 7), note(("CONTROL_NOT_SUPPORTED",), r'control "([^"]+)"')),
        "binddn": F.coalesce(note(binds, r'BIND dn="?([^"]*?)"?(?: (?:method|mech)=.*)?$'), note(("DO_BIND_INVALID",), r"\(([^)]+)\)"), note(("LDAP_BACK_DOBINT", "LDAP_BACK_RETRY"), r'DN="([^"]+)"')),
        "method": F.coalesce(note(("BIND", "BIND_ANON"), r"(?:method|mech)=(\d+)").try_cast("int"), F.when(k == "BIND_ANON", 0)),
        "mech": note(("BIND_DN_INFO", "BIND_ANON"), r"mech=([A-Za-z][A-Za-z0-9_-]*)"),
        "authcid": note(("BIND_AUTH",), r'authcid="([^"]*)"'), "authzid": note(("BIND_AUTH",), r'authzid="([^"]*)"'),
        "dn": note(("MOD", "ADD", "DEL", "MODRDN", "CMP"), r'\bdn="?([^"]+?)(?:"|$)'),
        "base": F.coalesce(group("srch", 1), group("srch", 2)), "scope": group("srch", 3).try_cast("int"), "deref": group("srch", 4).try_cast("int"), "filter": F.regexp_replace(group("srch", 5), r'^"(.*)"$', "$1"),
        "attrs": F.coalesce(note(("SRCH_ATTR", "MOD"), r"(?:SRCH|MOD) attr(?:=|:\s+)(.*)$"), F.regexp_replace(note(("NOT_INDEXED",), r"(?i)(?:mdb|bdb)_[a-z_]+: \(?([^)]+?)\)?\s+not indexed"), r"[()]", ""), note(("CMP",), r'attr="?([^"\s]+)')),
        "msgid": note(("ABANDON", "UNBIND"), r"msg(?:id)?=(\d+)").try_cast("int"),
        "oid": F.coalesce(group("res", 2), note(("EXT", "GLOBAL_CONTROL", "GET_CTRLS"), r'oid="?([\d.]+)')),
        "csn": note(("CSN_GET", "CSN_QUEUE", "CSN_GRADUATE"), r"(?:new csn=|queueing\s+\S+\s+|removing\s+\S+\s+)(\S+)"),
        "manage": note(("CSN_GET",), r"manage=(\d+)").try_cast("int"),
        "not_indexed": F.when(k == "NOT_INDEXED", F.lit(True)),
        "session_ip": F.coalesce(group("block", 1), F.try_element_at("track", F.lit("IP"))),
        "session_name": F.coalesce(group("block", 2), F.try_element_at("track", F.lit("NAME"))),
        "session_username": F.coalesce(group("block", 3), F.try_element_at("track", F.lit("USERNAME"))),
    }
    return as_events(df, fields)


def parse_version_banner(events: DataFrame) -> DataFrame:
    """(file, version): that of the first OpenLDAP banner of a file."""
    version = grab(F.col("raw"), r"\$OpenLDAP: slapd\s+(?:\S+\s+)?(\d+\.\d+[^\s(]*)")
    return events.where("kind = 'VERSION'").groupBy("file").agg(F.min_by(version, "ord").alias("version"))


# ----- 389-ds -----

DS389_VERBS = {"UNBIND": "UNBIND", "SRCH": "SRCH", "CMP": "CMP", "MODRDN": "MODRDN", "MOD": "MOD", "ADD": "ADD", "DEL": "DEL", "EXT": "EXT", "ABANDON": "ABANDON", "AUTOBIND": "DS_AUTOBIND", "ENTRY": "ENTRY", "REFERRAL": "REFERRAL", "STAT": "STAT", "VLV": "VLV", "SORT": "SORT", "BIND": "BIND"}


def parse_ds389_text(lines: DataFrame) -> DataFrame:
    """389-ds access lines; tab-led and empty lines are titles. op=-1 is no operation, op=m(i)(n) is m."""
    raw = F.col("raw")
    # "[time] conn=... [op=...] what": the time ends at the first closing bracket.
    timed = raw.startswith("[") & raw.contains("] ") & (F.instr(raw, "/") > 0)
    df = lines.withColumns({"format": F.lit("389ds"), "ts_text": F.when(timed, F.substring_index(F.substring(raw, 2, 64), "]", 1)), "p": F.when(timed, F.substring(raw, F.instr(raw, "] ") + 2, F.length(raw)))})
    df = settled(df.withColumn("ts_ns", T.from_bracketed(F.col("ts_text"))), "ts_text", "ts_ns", "p")
    p = F.when(F.col("ts_ns").isNotNull(), F.regexp_replace(F.col("p"), r"^(conn=\d+) \(Internal\)", "$1"))
    ids = F.split(p, " ", 3)
    first, second, third = (F.get(ids, F.lit(i)) for i in range(3))
    conn = F.regexp_replace(F.when(first.startswith("conn="), F.substring(first, 6, 40)), r"^Internal\((\d+)\)$", "$1").try_cast("bigint")
    op = F.when(second.startswith("op="), F.regexp_replace(F.substring(second, 4, 40), r"\(.*$", "").try_cast("bigint"))
    what = F.when(conn.isNotNull(), F.when(second.startswith("op="), third).otherwise(F.concat_ws(" ", second, third)))
    df = df.withColumns({"conn": conn, "op": F.when(op >= 0, op), "rest": what})
    df = settled(df, "conn", "op", "rest")
    r = F.col("rest")
    verb = grab(r, r"^([A-Z]+)")
    result = F.when(number(r, "tag") == 101, "SEARCH_RESULT").otherwise("RESULT")
    kind = F.when(r.rlike(r"^fd=\d+ (?:slot=\d+ )?(?:SSL )?connection from "), "ACCEPT").when(r.rlike(r"^fd=\d+ (?:slot=\d+ )?Disconnect - "), "CLOSED").when(r.startswith("TLSv"), "TLS")
    kind = kind.when(verb == "RESULT", result).when(r.startswith("UNPROCESSED OPERATION"), "UNPROCESSED")
    for name, k in DS389_VERBS.items():
        kind = kind.when(verb == name, k)
    kind = F.when((raw == "") | raw.startswith("\t"), "TITLE").when(r.isNull(), "UNKNOWN_LINE").otherwise(kind.otherwise("UNKNOWN_OP"))
    df = settled(df.withColumn("kind", kind), "kind")
    k = F.col("kind")
    tokens = F.when(k.isin("RESULT", "SEARCH_RESULT"), F.regexp_replace(r, r"\s- .*$", ""))
    method = grab(r, r"method=(\w+)")
    text = F.coalesce(grab(r, r"^RESULT .*?\s- (.*)$"), grab(r, r"^RESULT - (.*)$"))
    return as_events(df, {
        "ts": T.to_ts(F.col("ts_ns")), "fd": grab(r, r"^fd=(\d+)").try_cast("int"),
        "src": F.when(k == "ACCEPT", grab(r, r"connection from (.*?)(?: to |$)")), "reason": F.coalesce(F.when(k == "CLOSED", grab(r, r"Disconnect - (.*)$")), F.when(k == "UNPROCESSED", grab(r, r"^UNPROCESSED OPERATION(.*)$"))),
        "binddn": F.when(k.isin("BIND", "DS_AUTOBIND"), quoted(r, "dn")), "dn": F.when(k != "DS_AUTOBIND", quoted(r, "dn")),
        "method": F.when(k == "BIND", F.when(method == "sasl", 163).otherwise(method.try_cast("int"))), "mech": F.when(k == "BIND", F.coalesce(quoted(r, "mech"), F.when(method == "sasl", "sasl"))),
        "base": F.when(k == "SRCH", quoted(r, "base")), "scope": F.when(k == "SRCH", number(r, "scope")), "filter": F.when(k == "SRCH", grab(r, r'filter="([^"]*)"')),
        "attrs": F.when(k == "SRCH", quoted(r, "attrs")).when(k == "CMP", quoted(r, "attr")), "authzid": quoted(r, "authzid"),
        "err": number(tokens, "err"), "tag": number(tokens, "tag"), "nentries": F.coalesce(number(tokens, "nentries"), F.when(k == "ABANDON", number(r, "nentries"))),
        "etime": F.coalesce(number(tokens, "etime", "double"), F.when(k == "ABANDON", number(r, "etime", "double"))), "qtime": number(tokens, "wqtime", "double"), "csn": quoted(tokens, "csn"),
        "text": F.when(k.isin("RESULT", "SEARCH_RESULT"), text), "msgid": F.when(k == "ABANDON", number(r, "msgid")), "oid": F.when(k == "EXT", quoted(r, "oid")),
        "not_indexed": F.when(tokens.rlike(r"(?:^|\s)notes=\S*[UA]"), F.lit(True)),
    })


JSON_KINDS = {"CONNECTION": "ACCEPT", "DISCONNECT": "CLOSED", "SEARCH": "SRCH", "COMPARE": "CMP", "MODIFY": "MOD", "DELETE": "DEL", "EXTENDED_OP": "EXT", "AUTOBIND": "DS_AUTOBIND", "TLS_INFO": "TLS", "TLS_CLIENT_INFO": "TLS"}


def parse_ds389_json(records: DataFrame) -> DataFrame:
    """389-ds JSON records (rec) of access and errors logs; a header is a title, what is no object is unknown."""
    r = F.col("rec")
    op = r["operation"]
    nothing = F.coalesce(r["local_time"], r["operation"], r["severity"], r["header"]["version"]).isNull()
    kind = F.when(nothing, "UNKNOWN_LINE").when(r["header"].isNotNull(), "TITLE").when(r["severity"].isNotNull(), "SERVER_LOG").when(op == "RESULT", F.when(r["tag"] == 101, "SEARCH_RESULT").otherwise("RESULT"))
    for name, k in JSON_KINDS.items():
        kind = kind.when(op == name, k)
    for name in ("BIND", "UNBIND", "ADD", "MOD", "MODRDN", "DEL", "EXT", "ABANDON", "CMP", "SRCH", "ENTRY", "REFERRAL", "STAT", "VLV", "SORT"):
        kind = kind.when(op == name, name)
    df = records.withColumns({"format": F.lit("389ds-json"), "kind": kind.otherwise("UNKNOWN_OP"), "ts_text": r["local_time"], "ts_ns": T.from_rfc3339(r["local_time"])})
    df = settled(df, "rec", "kind", "ts_ns")
    k = F.col("kind")
    attrs = F.when(k == "SRCH", F.coalesce(F.nullif(F.array_join(r["attrs"], ","), F.lit("")), F.lit("ALL"))).when(k == "CMP", r["cmp_attr"]).when(k == "SERVER_LOG", r["subsystem"])
    empty = lambda c: F.nullif(c, F.lit(""))
    return as_events(df, {
        "ts": T.to_ts(F.col("ts_ns")), "conn": F.when(r["conn_id"] == -1, 0).otherwise(r["conn_id"]), "op": F.when(r["op_id"] >= 0, r["op_id"]), "fd": r["fd"], "src": empty(r["client_ip"]),
        "reason": F.coalesce(empty(r["close_reason"]), r["severity"]), "binddn": empty(r["bind_dn"]), "dn": F.coalesce(empty(r["target_dn"]), F.when(k == "BIND", empty(r["bind_dn"]))),
        "method": F.when(F.lower(r["method"]) == "sasl", 163).otherwise(r["method"].try_cast("int")), "mech": empty(r["mech"]), "base": empty(r["base_dn"]), "scope": r["scope"], "filter": empty(r["filter"]), "attrs": attrs,
        "err": r["err"], "tag": r["tag"], "nentries": r["nentries"], "etime": r["etime"].try_cast("double"), "qtime": r["wqtime"].try_cast("double"), "text": empty(r["msg"]), "csn": empty(r["csn"]), "oid": F.coalesce(empty(r["oid"]), empty(r["name"])), "msgid": r["msgid"],
        "not_indexed": F.when(F.exists(r["notes"], lambda n: n["note"].isin("U", "A")), F.lit(True)),
    })


def parse_ds389_errors(lines: DataFrame) -> DataFrame:
    """[time] - SEVERITY - [subsystem - ]message; a line without time goes on with the message before."""
    raw = F.col("raw")
    shape = r"^\[([^\]]+)\] - ([A-Z]+) - (?:(\S+) - )?(.*)$"
    df = lines.withColumns({"format": F.lit("389ds"), "ts_text": grab(raw, shape, 1)})
    df = df.withColumns({"kind": F.when((raw == "") | raw.startswith("\t"), "TITLE").when(F.col("ts_text").isNotNull(), "SERVER_LOG").otherwise("SERVER_LOG_CONT"), "ts_ns": T.from_bracketed(F.col("ts_text"))})
    return as_events(df, {"ts": T.to_ts(F.col("ts_ns")), "reason": grab(raw, shape, 2), "attrs": grab(raw, shape, 3), "text": grab(raw, shape, 4)})


# ----- OpenDJ -----

DJ_REQUESTS = {"BIND": "BIND", "SEARCH": "SRCH", "ADD": "ADD", "DELETE": "DEL", "MODIFY": "MOD", "MODDN": "MODRDN", "MODIFYDN": "MODRDN", "COMPARE": "CMP", "EXTENDED": "EXT", "ABANDON": "ABANDON", "UNBIND": "UNBIND"}
DJ_SCOPES = ("baseObject", "singleLevel", "wholeSubtree", "subordinateSubtree")
DJ_HEADER = r"^\[([^\]]+)\] (.*)$"


def parse_opendj(lines: DataFrame) -> DataFrame:
    """VERB REQ|RES key=value lines; times spent come in milliseconds and leave in seconds."""
    raw = F.col("raw")
    df = lines.withColumns({"format": F.lit("opendj"), "ts_text": grab(raw, DJ_HEADER, 1), "p": grab(raw, DJ_HEADER, 2)})
    p = F.regexp_replace(F.col("p"), r"\smsg=.*$", "")
    verb, phase = grab(p, r"^([A-Z]+)"), grab(p, r"^[A-Z]+ (REQ|RES)\b")
    kind = F.when(verb == "CONNECT", "ACCEPT").when(verb == "DISCONNECT", "CLOSED").when(verb == "TLS", "TLS").when(phase == "RES", F.when(verb == "SEARCH", "SEARCH_RESULT").otherwise("RESULT"))
    for name, k in DJ_REQUESTS.items():
        kind = kind.when((phase == "REQ") & (verb == name), k)
    df = df.withColumns({"kind": F.when(F.col("p").isNull(), "UNKNOWN_LINE").otherwise(kind.otherwise("UNKNOWN_OP")), "ts_ns": T.from_bracketed(F.col("ts_text"))})
    df = settled(df, "ts_text", "ts_ns", "p", "kind")
    p = F.regexp_replace(F.col("p"), r"\smsg=.*$", "")
    k = F.col("kind")
    ended = k.isin("RESULT", "SEARCH_RESULT")
    scope = F.nullif(F.array_position(F.array(*map(F.lit, DJ_SCOPES)), quoted(p, "scope")), F.lit(0)) - 1
    return as_events(df, {
        "ts": T.to_ts(F.col("ts_ns")), "conn": number(p, "conn", "bigint"), "op": number(p, "op", "bigint"), "msgid": number(p, "msgID"), "src": F.when(k == "ACCEPT", quoted(p, "from")),
        "reason": F.when(k == "CLOSED", quoted(p, "reason")), "text": F.when(k == "ACCEPT", quoted(p, "protocol")).when(ended, grab(F.col("p"), r'\smsg="?(.*?)"?$')),
        "binddn": F.when(k == "BIND", quoted(p, "dn")).when(verb == "BIND", quoted(p, "authDN")), "dn": quoted(p, "dn"),
        "method": F.when(k == "BIND", F.when(quoted(p, "type") == "SIMPLE", 128).when(quoted(p, "type") == "SASL", 163)), "base": F.when(k == "SRCH", quoted(p, "base")), "scope": scope,
        "filter": F.when(k == "SRCH", grab(p, r'filter="([^"]*)"')), "attrs": F.when(k == "SRCH", quoted(p, "attrs")).when(k == "CMP", quoted(p, "attr")), "oid": F.when(k == "EXT", F.coalesce(quoted(p, "oid"), quoted(p, "name"))),
        "err": F.when(ended, number(p, "result")), "nentries": F.when(ended, number(p, "nentries")), "etime": F.when(ended, number(p, "etime", "double") / 1000), "authzid": quoted(p, "authzID"),
        "tls_started": F.when((verb == "EXTENDED") & (phase == "RES") & (quoted(p, "name") == "StartTLS") & (number(p, "result") == 0), F.lit(True)),
    })


def parse_opendj_errors(lines: DataFrame) -> DataFrame:
    """category= severity= msgID= msg= lines; lines that begin otherwise go on with the message before."""
    raw = F.col("raw")
    df = lines.withColumns({"format": F.lit("opendj-errors"), "ts_text": grab(raw, DJ_HEADER, 1), "p": grab(raw, DJ_HEADER, 2)})
    p = F.col("p")
    kind = F.when(~raw.startswith("["), "SERVER_LOG_CONT").when(p.rlike(r"(?:^|\s)severity=\S"), "SERVER_LOG").otherwise("UNKNOWN_LINE")
    df = df.withColumns({"kind": kind, "ts_ns": T.from_bracketed(F.col("ts_text"))})
    return as_events(df, {"ts": T.to_ts(F.col("ts_ns")), "reason": quoted(p, "severity"), "attrs": quoted(p, "category"), "text": grab(p, r"\smsg=(.*)$"), "msgid": number(p, "msgID")})


# ----- all dialects -----

PARSERS: dict[str, Parser] = {
    "openldap": parse_openldap,
    "ds389-text": parse_ds389_text,
    "ds389-json": lambda lines: parse_ds389_json(read_ds389_json(lines)),
    "ds389-json-pretty": lambda lines: parse_ds389_json(read_ds389_json(lines)),
    "ds389-errors-text": parse_ds389_errors,
    "ds389-errors-json": lambda lines: parse_ds389_json(read_ds389_json(lines)),
    "opendj": parse_opendj,
    "opendj-errors": parse_opendj_errors,
}


def register_dialect(kind: str, parser: Parser) -> None:
    """Adds a dialect: ``parser`` turns lines into events of the canonical schema."""
    PARSERS[kind] = parser


def parse_files(lines: DataFrame, files: DataFrame, server: str | None = None) -> DataFrame:
    """Events of the kept files (file, kind, kept) among ``lines``, each parsed by its own dialect; ``server`` names what has no host.

    ``files`` has one row a file and is broadcast, so lines stay where they are. Where lines come from files as such,
    ``read_events`` does not even read what another dialect's parser is to have.
    """
    kept = files.where("kept").select("file", "kind")
    kinds = [r.kind for r in kept.select("kind").distinct().collect()]
    parts = [PARSERS[kind](lines.join(F.broadcast(kept.where(F.col("kind") == kind).select("file")), "file", "left_semi")) for kind in sorted(kinds)]
    return named(united(parts) if parts else as_events(lines.where("false"), {}), server)


def read_events(spark: SparkSession, paths: str | list[str], server: str | None = None, single_kind: bool = False, recursive: bool = False, year: int | None = None, tz: str = "UTC", mtime_days: int | None = None, max_files: int | None = None) -> DataFrame:
    """Events of log files, whatever their compression and dialect: each dialect's parser reads its own files only.

    Which files of a folder count is what ``sources.lines.list_files`` says of ``mtime_days`` and ``max_files``; what is
    left out of them, and why, is what ``inspect_files`` says. ``year`` and ``tz`` belong to year-less OpenLDAP headers.
    """
    files = inspect_files(spark, list_files(spark, paths, recursive, mtime_days, max_files), single_kind).where("kept").select("file", "kind", "compression").collect()
    parts = []
    for kind in sorted({f.kind for f in files}):
        own = [(f.file, f.compression) for f in files if f.kind == kind]
        lines = read_files(spark, own)
        lines = as_records(lines) if kind.endswith("-pretty") else lines
        parts.append(parse_openldap(lines, year=year, tz=tz) if kind == "openldap" else PARSERS[kind](lines))
    return named(united(parts) if parts else as_events(spark.createDataFrame([], LINES), {}), server)


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def named(events: DataFrame, server: str | None) -> DataFrame:
    return events.withColumn("server", F.coalesce("server", F.lit(server))) if server else events
