"""Columns of the canonical tables."""

from __future__ import annotations

#: (name, type) of one parsed line.
EVENT_FIELDS = [
    ("file", "string"), ("ord", "struct<block:bigint,seq:bigint>"), ("kind", "string"), ("format", "string"),
    ("ts_ns", "bigint"), ("ts", "timestamp"), ("ts_text", "string"), ("server", "string"), ("proc", "string"),
    ("conn", "bigint"), ("op", "bigint"), ("fd", "int"),
    ("err", "int"), ("tag", "int"), ("scope", "int"), ("deref", "int"), ("nentries", "int"), ("method", "int"), ("msgid", "int"), ("manage", "int"),
    ("qtime", "double"), ("etime", "double"),
    ("reason", "string"), ("src", "string"), ("authcid", "string"), ("authzid", "string"), ("binddn", "string"), ("dn", "string"), ("base", "string"),
    ("filter", "string"), ("attrs", "string"), ("text", "string"), ("oid", "string"), ("csn", "string"), ("mech", "string"),
    ("not_indexed", "boolean"), ("tls_started", "boolean"),
    ("track", "map<string,string>"), ("session_ip", "string"), ("session_name", "string"), ("session_username", "string"), ("raw", "string"),
]

#: Request lines by kind, with the label under which they are counted.
REQUEST_LABELS = {
    "BIND": "BIND", "BIND_AUTH": "BIND", "BIND_ANON": "BIND ANONYMOUS", "BIND_DN_INFO": "BIND DN", "SRCH": "SRCH", "SRCH_ATTR": "SRCH ATTR",
    "MOD": "MOD", "ADD": "ADD", "DEL": "DEL", "MODRDN": "MODRDN", "CMP": "CMP", "EXT": "EXT", "ABANDON": "ABANDON", "UNBIND": "UNBIND",
    "ACCEPT": "ACCEPT", "CLOSED": "CLOSED", "TLS": "TLS", "STARTTLS": "STARTTLS", "RESULT": "RESULT", "SEARCH_RESULT": "SEARCH RESULT",
    "SASL": "SASL", "TRACK": "TRACK", "NOT_INDEXED": "NOT INDEXED", "CONN_DEFER": "CONN DEFER",
}
READS, WRITES = ("BIND", "SRCH", "EXT", "CMP"), ("ADD", "DEL", "MOD", "MODRDN")
#: Kinds that end a life of an operation; kinds whose lines begin or enrich one.
ENDS = ("RESULT", "SEARCH_RESULT", "ABANDON", "UNBIND")
STARTS = ("BIND", "BIND_AUTH", "BIND_ANON", "BIND_DN_INFO", "SRCH", "SRCH_ATTR", "MOD", "ADD", "DEL", "MODRDN", "CMP", "EXT", "STARTTLS")
#: Lines that are recognised but say nothing of an operation, and lines that are not recognised.
TITLES = ("TITLE", "STAT", "ENTRY", "REFERRAL", "VLV", "SORT", "HAPROXY", "UNPROCESSED", "DS_AUTOBIND", "VERSION", "SERVER_LOG_CONT")
UNKNOWN = ("UNKNOWN_LINE", "UNKNOWN_OP")
#: A connection's key.
CONN = ("file", "server", "conn")
