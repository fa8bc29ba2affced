"""Operations, identities and connections rebuilt from interleaved lines.

Everything here is keyed by the connection (file, server, conn): the windows over it, those over the operation
within it and the grouping by life all use one exchange by that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dirlog.schema import CONN, ENDS, REQUEST_LABELS, STARTS
from dirlog.session import stored

PAGED_RESULTS = "1.2.840.113556.1.4.319"


def before() -> WindowSpec:
    """All lines of the connection before this one."""
    return Window.partitionBy(*CONN).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)


def latest(c: Column) -> Column:
    """The last value before this line that is not null."""
    return F.last(c, ignorenulls=True).over(before())


def filled(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def with_identity(events: DataFrame) -> DataFrame:
    """Adds who and bound (last bind DN) of the connection just before each line; lines without conn are left out.

    Last bind DN, else authcid, else a session's USERNAME, NAME or address, else unknown. A bind counts from its
    request on, even if it fails; an anonymous bind clears nothing.
    """
    lines = events.where("conn is not null")
    bound = F.when(F.col("kind").isin("BIND", "BIND_DN_INFO", "RESULT"), filled("binddn"))
    known = [latest(bound), latest(filled("authcid")), latest(filled("session_username")), latest(filled("session_name")), latest(filled("session_ip"))]
    return lines.withColumns({"who": F.coalesce(*known, F.lit("unknown")), "bound": known[0]})


def with_life(lines: DataFrame) -> DataFrame:
    """Adds life: how many times the operation's number was used up on this connection before the line."""
    return lines.withColumn("life", F.coalesce(F.sum(F.col("kind").isin(*ENDS).cast("int")).over(Window.partitionBy(*CONN, "op").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def build_operations(events: DataFrame) -> DataFrame:
    """One row for each life of an operation: request and result lines of one connection and number together.

    who and binddn are the connection's at the end line; what was asked comes from the request lines; end_kind is
    null while an operation is in flight; a result without request has no type.
    """
    lines = with_life(with_identity(events).where(F.col("op").isNotNull() & F.col("kind").isin(*STARTS, *ENDS)))
    kind = F.col("kind")
    end, asks = kind.isin(*ENDS), kind.isin(*STARTS)
    first = lambda c, on=asks: F.min_by(c, F.when(on & c.isNotNull(), F.col("ord")))
    label = F.create_map(*[F.lit(x) for k in (*STARTS, "ABANDON", "UNBIND") if k != "SRCH_ATTR" for x in (k, REQUEST_LABELS.get(k, k).split(" ")[0])])
    kinds = F.try_element_at(label, kind)
    col = F.col
    ended = F.struct("kind", "who", "bound", "nentries", "err", "tag", "etime", "qtime", "text", "ord", "ts_ns", "not_indexed")
    out = lines.groupBy(*CONN, "op", "life").agg(
        first(kinds, F.lit(True)).alias("type"),
        *[first(filled(c)).alias(c) for c in ("base", "filter", "authcid", "authzid", "attrs", "mech", "dn", "oid")],
        *[first(col(c)).alias(c) for c in ("scope", "deref")],
        F.max_by(ended, F.when(end, col("ord"))).alias("e"),
        F.min_by(F.struct("ord", "ts_ns"), "ord").alias("s"),
        F.max_by("who", "ord").alias("last_who"),
        F.max_by("bound", "ord").alias("last_bound"),
    )
    return out.select(
        *CONN, "op", "life", "type", F.coalesce("e.who", "last_who").alias("who"), "base", "filter", "attrs", "scope", "deref", F.coalesce("e.bound", "last_bound").alias("binddn"),
        "authcid", "authzid", "mech", "dn", "oid", "e.nentries", "e.err", "e.tag", "e.etime", "e.qtime", filled("e.text").alias("text"), "e.not_indexed",
        col("s.ord").alias("start_ord"), col("e.ord").alias("end_ord"), col("s.ts_ns").alias("start_ts_ns"), col("e.ts_ns").alias("end_ts_ns"), col("e.kind").alias("end_kind"),
    )


def completed(operations: DataFrame) -> DataFrame:
    """Operations that a result ended."""
    return operations.where("end_kind in ('RESULT', 'SEARCH_RESULT')")


def inflight_operations(operations: DataFrame) -> DataFrame:
    """Operations that nothing ended."""
    return operations.where("end_kind is null")


def build_connections(events: DataFrame) -> DataFrame:
    """One row for each CLOSED line: who, source, total etime and operations of the connection up to it.

    Nothing is reset on close, so a connection number used again goes on adding up.
    """
    lines = with_life(with_identity(events))
    one = F.row_number().over(Window.partitionBy(*CONN, "op", "life").orderBy("ord")) == 1
    asked = F.col("op").isNotNull() & one & F.col("kind").isin(*STARTS, "RESULT", "SEARCH_RESULT")
    took = F.when(F.col("kind").isin("RESULT", "SEARCH_RESULT"), F.col("etime"))
    lines = lines.withColumn("asked", asked.cast("int"))
    opened = F.when(F.col("kind") == "ACCEPT", F.struct("src", "ts_ns"))
    lines = lines.withColumns({"total_etime": F.coalesce(F.sum(took).over(before()), F.lit(0.0)), "ops_count": F.coalesce(F.sum("asked").over(before()), F.lit(0)), "opened": latest(opened)})
    closed = lines.where("kind = 'CLOSED'")
    return closed.select(*CONN, F.col("opened.src").alias("src"), "who", F.col("bound").alias("binddn"), F.round("total_etime", 9).alias("total_etime"), "ops_count", F.col("opened.ts_ns").alias("opened_ts_ns"), F.col("ts_ns").alias("closed_ts_ns"), "reason", "ord")


def bind_usage_rows(events: DataFrame) -> DataFrame:
    """One row for each bind: method, transport as of that line, whether its session is tracked."""
    lines = with_identity(events)
    tls = F.coalesce(F.max((F.col("kind") == "TLS") | F.coalesce("tls_started", F.lit(False)) | ((F.col("kind") == "ACCEPT") & (F.col("text") == "LDAPS"))).over(before()), F.lit(False))
    start = F.coalesce(F.max((F.col("kind") == "STARTTLS") | F.coalesce("tls_started", F.lit(False)) | ((F.col("kind") == "EXT") & (F.col("oid") == "1.3.6.1.4.1.1466.20037"))).over(before()), F.lit(False))
    rows = lines.withColumns({"tls": tls, "start_tls": start}).where("kind in ('BIND', 'BIND_ANON')")
    empty = F.coalesce(filled("binddn"), filled("dn")).isNull()
    method = F.when((F.col("kind") == "BIND_ANON") | (F.col("method") == 0) | ((F.col("method") == 128) & empty), "ANONYMOUS").when(F.col("method") == 128, "SIMPLE").when(F.col("method") == 163, "SASL").otherwise("OTHER")
    transport = F.when(F.col("tls") & F.col("start_tls"), "ldap + StartTLS").when(F.col("tls"), "ldaps").otherwise("ldap")
    session = F.coalesce(filled("session_ip"), filled("session_name"), filled("session_username")).isNotNull()
    return rows.select(*CONN, "op", "ord", method.alias("method"), transport.alias("transport"), "mech", session.alias("session_control"))


#: Rows of a small table of files up to which it is broadcast.
BROADCAST_FILES = 50_000


def small(df: DataFrame, rows: int = BROADCAST_FILES) -> DataFrame:
    """``df``, worked out and marked for broadcast if it has at most ``rows`` rows."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= rows else df


#: Places of a split that make a part of it, as a power of two, and rows of a table of parts up to which it is broadcast.
PART_BITS, BROADCAST_PARTS = 17, 200_000


def restart_epoch(events: DataFrame) -> DataFrame:
    """Adds restart: the number of "slapd starting" lines before the line in its file.

    Lines are counted by parts of a file: one row a part says how many start lines came before it and where its own
    are. A line is held against the start lines of its own part only, so its cost does not grow with the file, and
    no window sees more than a file's parts.
    """
    rows = events.withColumns({"_block": F.col("ord.block"), "_part": F.shiftright("ord.seq", PART_BITS)})
    key, start = ["file", "_block", "_part"], F.col("kind") == "SLAPD_STARTING"
    starts = rows.where(start).groupBy(*key).agg(F.collect_list("ord.seq").alias("_starts"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_block", "_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy(*key).agg(F.count(F.when(start, 1)).alias("_n")).withColumn("_before", F.coalesce(earlier, F.lit(0)))
    parts = parts.where(F.col("_before") + F.col("_n") > 0).drop("_n").join(starts, key, "left")
    own = F.coalesce(F.size(F.filter("_starts", lambda s: s < F.col("ord.seq"))), F.lit(0))
    out = rows.join(small(parts, BROADCAST_PARTS), key, "left").withColumn("restart", F.coalesce(F.col("_before") + F.when(F.col("_starts").isNull(), 0).otherwise(own), F.lit(0)).cast("int"))
    return out.select(*events.columns, "restart")


def session_correlations(events: DataFrame) -> DataFrame:
    """Per (server, restart, conn) with session tracking: first time, real address, name, user, accept address, bind DN."""
    lines = with_identity(restart_epoch(events)).withColumn("accept", latest(F.when(F.col("kind") == "ACCEPT", F.col("src"))))
    tracked = lines.where(F.coalesce(filled("session_ip"), filled("session_name"), filled("session_username")).isNotNull())
    early = lambda c: F.min_by(filled(c), F.when(filled(c).isNotNull(), F.struct("file", "ord")))
    return tracked.groupBy("server", "restart", "conn").agg(F.min("ts_ns").alias("first_ts_ns"), early("session_ip").alias("real_ip"), early("session_name").alias("name"), early("session_username").alias("username"), early("accept").alias("accept"), early("bound").alias("binddn"))


def distinct_correlations(correlations: DataFrame) -> DataFrame:
    """The first of each (accept, real address, name, user, bind DN)."""
    keys = ["accept", "real_ip", "name", "username", "binddn"]
    return correlations.groupBy(*keys).agg(F.min(F.struct("first_ts_ns", "server", "restart", "conn")).alias("f")).select("f.*", *keys)


def paged_by_control(events: DataFrame) -> DataFrame:
    """(who, pages): each paged-results control goes to the next line of its file that names a connection.

    Only files that hold such lines are looked at, and lines are put in order within a block of a file, as Spark read
    it. What follows the last named line of a block belongs to the first one of the next: one row a block.
    """
    mark = (F.col("kind") == "GET_CTRLS") & (F.col("oid") == PAGED_RESULTS)
    held = events.join(small(events.where(mark).select("file").distinct()), "file", "left_semi")
    named = with_identity(held).select("file", "ord", F.struct("who").alias("owner"), F.lit(False).alias("paged"))
    marks = held.where(mark).select("file", "ord", F.lit(None).cast("struct<who:string>").alias("owner"), F.lit(True).alias("paged"))
    rows = named.union(marks).withColumn("block", F.col("ord.block"))
    later = Window.partitionBy("file", "block").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last("owner", ignorenulls=True).over(later)).where("paged").select("file", "block", "next")
    within = rows.where("next is not null").groupBy("next.who").agg(F.count("*").alias("pages"))
    # Marks that no named line of their own block follows.
    firsts = named.groupBy("file", F.col("ord.block").alias("block")).agg(F.min_by("owner", "ord").alias("first"), F.lit(0).alias("marks"))
    open_marks = rows.where("next is null").groupBy("file", "block").agg(F.lit(None).cast("struct<who:string>").alias("first"), F.count("*").alias("marks"))
    ends = firsts.union(open_marks).groupBy("file", "block").agg(F.max("first").alias("first"), F.sum("marks").alias("marks"))
    following = Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    across = ends.withColumn("next", F.last("first", ignorenulls=True).over(following)).where("marks > 0 and next is not null")
    return within.union(across.groupBy("next.who").agg(F.sum("marks").alias("pages"))).groupBy("who").agg(F.sum("pages").alias("pages"))


def paged_by_shape(events: DataFrame, operations: DataFrame) -> DataFrame:
    """(who, pages): runs of the same search on a connection with equal counts but for a smaller last one.

    A run counts when another search or the close ends it; another operation or the end of the file drops it.
    """
    ops = completed(operations).select(*CONN, F.col("end_ord").alias("ord"), "who", F.when(F.col("type") == "SRCH", F.concat_ws("\u0001", "base", "filter", F.col("scope").cast("string"), "attrs")).alias("shape"), "nentries", F.lit("op").alias("what"))
    closed = events.where("kind = 'CLOSED' and conn is not null").select(*CONN, "ord", F.lit(None).alias("who"), F.lit(None).alias("shape"), F.lit(None).alias("nentries"), F.lit("closed").alias("what"))
    w = Window.partitionBy(*CONN).orderBy("ord")
    rows = ops.union(closed).withColumn("new", F.coalesce(~F.col("shape").eqNullSafe(F.lag("shape").over(w)) | F.col("shape").isNull(), F.lit(True)).cast("int"))
    rows = rows.withColumns({"run": F.sum("new").over(w), "last": F.lead("new").over(w) == 1, "next": F.lead(F.struct("what", "shape")).over(w)})
    runs = rows.where("shape is not null").groupBy(*CONN, "run").agg(
        F.count("*").alias("n"), F.max_by(F.struct("who", "nentries", "next"), "ord").alias("e"), F.min(F.when(F.coalesce("last", F.lit(True)), F.lit(None)).otherwise(F.col("nentries"))).alias("least"), F.max(F.when(F.coalesce("last", F.lit(True)), F.lit(None)).otherwise(F.col("nentries"))).alias("most")
    )
    ended = (F.col("e.next.what") == "closed") | F.col("e.next.shape").isNotNull()
    good = runs.where(ended & (F.col("n") > 1) & (F.col("least") == F.col("most")) & (F.col("e.nentries") < F.col("most")))
    return good.groupBy(F.col("e.who").alias("who")).agg(F.sum("n").alias("pages"))


def foreign_servers(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Servers of a batch that the known ones (server) do not hold."""
    return batch.select("server").where("server is not null").distinct().join(known.select("server").distinct(), "server", "left_anti")
