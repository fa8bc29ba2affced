"""Log files as lines with their exact order, whatever their compression; choosing and naming files."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "file string, ord struct<block:bigint,seq:bigint>, raw string"
#: Magic bytes of compressed files, with their name, what opens them and what decompresses a part of one.
MAGIC = {
    b"\x1f\x8b": ("gz", gzip.open, lambda: zlib.decompressobj(31)),
    b"BZh": ("bz2", bz2.open, bz2.BZ2Decompressor),
    b"\xfd7zXZ\x00": ("xz", lzma.open, lzma.LZMADecompressor),
}
#: Lines of a file that name its dialect, lines that a helper hands over at once, bytes read of a file's head (bz2
#: says nothing before its first block is whole), files whose heads are held at once, and threads that read them.
HEAD, BATCH, HEAD_BYTES, HEAD_BYTES_BZ2, FILES, THREADS = 200, 20_000, 1 << 16, 1 << 20, 500, 16
#: Names of logs, and endings of files that are none.
LOG_NAME, NO_LOG = r"(?i)(slapd|ldap|\.log)", r"(?i)(~|\.swp|\.tmp|\.bak|\.old|\.disabled)$"
#: 389-ds JSON keys that are read.
DS389_JSON = (
    "local_time string, operation string, conn_id bigint, op_id bigint, fd int, client_ip string, close_reason string, bind_dn string, method string, mech string, "
    "base_dn string, scope int, filter string, attrs array<string>, err int, tag int, nentries int, etime string, wqtime string, msg string, csn string, "
    "notes array<struct<note:string>>, target_dn string, cmp_attr string, oid string, name string, msgid int, header struct<version:string,instance:string>, severity string, subsystem string"
)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ord, raw) of plain, .gz and .bz2 files; carriage returns at line ends are dropped.

    ord sorts a file's lines in their order: the start of the split, then the row number within the plan.
    """
    df = spark.read.text(paths, wholetext=False)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return df.select(F.col("_metadata.file_path").alias("file"), order.alias("ord"), F.regexp_replace("value", r"\r+$", "").alias("raw"))


def compression(first: bytes) -> str | None:
    """Name of a file's compression by its first bytes; None for plain files."""
    return next((name for magic, (name, _, _) in MAGIC.items() if first.startswith(magic)), None)


def is_local(path: str) -> bool:
    return path.startswith(("/", "file:"))


def read_compressed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, ord, raw) of .xz files and of files whose name hides their compression, told by their first bytes.

    One task for each file, which streams its lines. Files that executors cannot open by themselves come through
    Spark's binary reader, which refuses files above 2 GB (as stored) with an error.
    """
    local, remote = [p for p in paths if is_local(p)], [p for p in paths if not is_local(p)]
    listed = spark.createDataFrame([(p, None) for p in local], "path string, content binary").repartition(max(1, len(local)))
    if remote:
        listed = listed.union(spark.read.format("binaryFile").load(remote).select("path", "content"))

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(local_path(path), "rb") if content is None else io.BytesIO(content) as f:
                    first = f.read(6)
                    f.seek(0)
                    opener = next((o for magic, (_, o, _) in MAGIC.items() if first.startswith(magic)), None)
                    held, n = [], 0
                    for piece in opener(f, "rb") if opener else f:
                        held.append(piece.rstrip(b"\r\n").decode("utf-8", "replace"))
                        if len(held) == BATCH:
                            yield as_batch(path, n, held)
                            held, n = [], n + BATCH
                    if held:
                        yield as_batch(path, n, held)

    return listed.mapInArrow(rows, LINES)


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def as_batch(path: str, first: int, lines: list[str]) -> pa.RecordBatch:
    seq = pa.array(range(first, first + len(lines)), pa.int64())
    order = pa.StructArray.from_arrays([pa.array([0] * len(lines), pa.int64()), seq], ["block", "seq"])
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), order, pa.array(lines)], ["file", "ord", "raw"])


def select_inputs(spark: SparkSession, dirs: str | list[str], recursive: bool = False, mtime_days: int | None = None, max_files: int | None = None) -> DataFrame:
    """(path, modified, length) of the files that look like logs, sorted by path.

    Not empty, named like a log, neither hidden nor a leftover; changed within ``mtime_days``; the
    ``max_files`` newest. Only the listing is read, no content.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(dirs).select("path", F.col("modificationTime").alias("modified"), "length")
    name = F.element_at(F.split("path", "/"), -1)
    df = df.where((F.col("length") > 0) & name.rlike(LOG_NAME) & ~name.rlike(NO_LOG) & ~name.startswith(".")).dropDuplicates(["path"])
    if mtime_days is not None:
        df = df.where(F.col("modified") >= F.current_timestamp() - F.make_dt_interval(days=F.lit(mtime_days)))
    if max_files is not None:
        df = df.orderBy(F.desc("modified"), "path").limit(max_files)
    return df.orderBy("path")


def line_kind(raw: Column) -> Column:
    """What dialect a single line speaks for; null where it says nothing."""
    bracket = raw.rlike(r"^\[\d{2}/")
    dj = r"^\[[^\]]*\] (?:(?:CONNECT|DISCONNECT|TLS)\b|(?:BIND|SEARCH|ADD|DELETE|MODIFY|MODDN|MODIFYDN|COMPARE|ABANDON|UNBIND|EXTENDED) (?:REQ|RES)\b)"
    header = r"^(?:[0-9a-f]+\.[0-9a-f]+ +0x[0-9a-f]+ |\[?\d{4}-\d{2}-\d{2}T\S+\]? |[A-Z][a-z]{2} +\d+ \d{2}:\d{2}:\d{2} )"
    return (
        F.when(raw.rlike(r"^(?:LOGINFO:|time: )"), "ds389-other")
        .when(bracket & raw.rlike(r"^\[[^\]]*\] conn="), "ds389-text")
        .when(bracket & raw.rlike(r"^\[[^\]]*\] - "), "ds389-errors-text")
        .when(bracket & raw.rlike(r"^\[[^\]]*\] category=\S* severity="), "opendj-errors")
        .when(raw.rlike(dj), "opendj")
        .when(raw.startswith("{") & raw.contains('"eventName"'), "opendj-audit")
        .when(raw.contains('"severity"') & raw.rlike(r'^\s*[{"]'), "ds389-errors-json")
        .when(raw.rlike(r'^\s*[{"].*"(?:gm_time|utc_time|event)"'), "ds389-other")
        .when(raw.rlike(r'^\{.*"operation"'), "ds389-json")
        .when(raw.rlike(r'^\s+"operation"'), "ds389-json-pretty")
        .when(raw.rlike(header), "openldap")
    )


def file_heads(spark: SparkSession, paths: list[str]) -> Iterator[list[tuple[str, int, str | None, list[str]]]]:
    """(path, length, compression, first lines) of some files at a time; length -1 where a file cannot be read.

    The first bytes of each file are read as the listing is, by the driver and through Hadoop, so any file system will do.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(name: str) -> tuple[str, int, str | None, list[str]]:
        try:
            path = jvm.org.apache.hadoop.fs.Path(name)
            fs = path.getFileSystem(conf)
            length = fs.getFileStatus(path).getLen()
            stream = fs.open(path)
            try:
                data = bytes(stream.readNBytes(HEAD_BYTES))
                kind = compression(data)
                if kind == "bz2" and length > len(data):
                    data += bytes(stream.readNBytes(HEAD_BYTES_BZ2))
            finally:
                stream.close()
            if kind:
                data = next(make for _, (n, _, make) in MAGIC.items() if n == kind)().decompress(data)
            return name, length, kind, [line.rstrip("\r") for line in data.decode("utf-8", "replace").split("\n")[:HEAD]]
        except Exception as error:  # noqa: BLE001
            if "java" not in str(type(error)) + str(error) and not isinstance(error, (OSError, zlib.error, lzma.LZMAError, EOFError)):
                raise
            return name, -1, None, []

    with ThreadPoolExecutor(THREADS) as pool:
        for i in range(0, len(paths), FILES):
            yield list(pool.map(head, paths[i : i + FILES]))


def inspect_files(spark: SparkSession, paths: list[str], single_kind: bool = False) -> DataFrame:
    """(file, kind, kept, reason, compression, length) of files: which dialect each speaks, and why one is left out.

    Only heads are read. One row a file, so the table is as small as the listing.
    """
    found, seen = [], []
    for heads in file_heads(spark, paths):
        lines = [(name, (0, i), line) for name, _, _, head in heads for i, line in enumerate(head)]
        named = {r.file: r.kind for r in classify_files(spark.createDataFrame(lines, LINES)).collect()} if lines else {}
        found += [(n, "unreadable" if length < 0 else "empty" if not length else named.get(n, "not-a-log")) for n, length, _, _ in heads]
        seen += [(n, kind, length) for n, length, kind, _ in heads]
    kinds = spark.createDataFrame(found, "file string, kind string")
    return select_run_kind(kinds, single_kind).join(F.broadcast(spark.createDataFrame(seen, "file string, compression string, length long")), "file")


def list_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, mtime_days: int | None = None, max_files: int | None = None) -> list[str]:
    """The files that paths, folders and patterns stand for, as the file system names them, sorted.

    Files named outright, or by a pattern, are always among them. Of a folder's files, hidden ones and leftovers of
    editors and rotation are left out, as are those not changed within ``mtime_days``, and all but the ``max_files`` newest.
    """
    since = 0 if mtime_days is None else (time.time() - 86_400 * mtime_days) * 1000
    held: list[tuple[int, str]] = []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: list[str] = []
    todo = [(p, True) for p in ([paths] if isinstance(paths, str) else paths)]
    while todo:
        name, named = todo.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        for status in (fs.globStatus(path) or []) if named else fs.listStatus(path):
            child = status.getPath().toString()
            base = status.getPath().getName()
            if status.isFile() and named:
                out.append(child)
            elif status.isFile() and not base.startswith((".", "_")) and not re.search(NO_LOG, base) and status.getModificationTime() >= since:
                held.append((-status.getModificationTime(), child))
            elif status.isDirectory() and (named or recursive):
                todo.append((child, False))
    return sorted({*out, *(child for _, child in sorted(set(held))[:max_files])})


def read_files(spark: SparkSession, files: list[tuple[str, str | None]]) -> DataFrame:
    """(file, ord, raw) of files with their compression: by Spark's reader where the name shows it, else by the helper."""
    shown = [p for p, c in files if c is None and not p.endswith((".gz", ".bz2", ".xz")) or c in ("gz", "bz2") and p.endswith(f".{c}")]
    hidden = sorted({p for p, _ in files} - set(shown))
    out = read_lines(spark, shown) if shown else None
    if hidden:
        more = read_compressed(spark, hidden)
        out = out.unionByName(more) if out is not None else more
    return out


def classify_files(lines: DataFrame) -> DataFrame:
    """(file, kind): the dialect of the first line of each file's head that speaks for one, else not-a-log.

    Heads are taken by a rank limit that Spark applies before the shuffle as well as after it.
    """
    w = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    head = lines.select("file", "ord", line_kind(F.col("raw")).alias("kind"), w.alias("n")).where(F.col("n") <= HEAD)
    return head.groupBy("file").agg(F.coalesce(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit("not-a-log")).alias("kind"))


#: Kinds that are read; the others are named and left out.
READABLE = ("openldap", "ds389-text", "ds389-json", "ds389-json-pretty", "ds389-errors-text", "ds389-errors-json", "opendj", "opendj-errors")


def select_run_kind(files: DataFrame, single_kind: bool = False) -> DataFrame:
    """(file, kind, kept, reason). With ``single_kind`` the first readable file by path fixes the kind of the run."""
    first = files.where(F.col("kind").isin(*READABLE)).agg(F.min_by("kind", "file").alias("run_kind"))
    reason = F.when(F.col("kind") == "not-a-log", "not a log").when(F.col("kind").isin("empty", "unreadable"), F.col("kind")).when(F.col("kind").isin("ds389-other", "opendj-audit"), "audit or security stream")
    if single_kind:
        reason = reason.when(F.col("kind") != F.col("run_kind"), "another kind than the run's")
    out = files.join(F.broadcast(first)).withColumn("reason", reason)
    return out.select("file", "kind", F.col("reason").isNull().alias("kept"), "reason")


#: A JSON string, to the line's end where it is not closed, and a part of a line that ends at a closing brace or with
#: the line. Nothing is tried twice, so a part costs its length.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+"?'
JSON_PART = rf'(?:[^"}}]++|{JSON_STRING})*+\}}?'
PART = re.compile(JSON_PART.encode())


def cut_between(before: Column, after: Column) -> Column:
    """Whether no JSON value goes on from one part (trimmed) to the next, so that a record starts with the latter.

    A value goes on after an opening bracket, comma or colon, and before a closing bracket, comma or colon. An object
    follows neither another's opening brace nor the comma after a plain value: there a record broke off.
    """
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    goes_on = last.isin("{", "[", ",", ":") | first.isin("}", "]", ",", ":")
    return ~goes_on | ((first == "{") & ((last == "{") | ((last == ",") & (before != ","))))


#: What the helper returns: pieces of a file's runs of lines, with their neighbourhood; white space; bytes that a value goes on after and before.
PIECES = LINES + ", first boolean, last boolean, head string, tail string, until struct<block:bigint,seq:bigint>"
SPACE, OPEN_AFTER, OPEN_BEFORE = " \t\n\x0b\f\r", np.frombuffer(b"{[,:", np.uint8), np.frombuffer(b"}],:", np.uint8)


def as_records(lines: DataFrame) -> DataFrame:
    """(file, ord, raw) of lines of JSON in any layout, as files are read: one whole record a row, with the place of its first line.

    Lines are cut behind closing braces outside strings. Where a record starts shows in two neighbouring parts, whatever
    the depth, so a record that broke off ends at the next one's start and what is no JSON stays apart, a row a line. Only one that
    broke off right behind a colon, an opening bracket or the comma after an object takes the next along as unknown.
    Each task cuts the lines it reads, so lines are neither sorted nor shuffled; only the first and last record of
    each split are held against those of the next.
    """
    pieces = lines.select("file", "ord", "raw").mapInArrow(cut_records, PIECES)
    order = Window.partitionBy("file").orderBy("ord", "last")
    ends = pieces.where("first or last").withColumn("before", F.lag(F.struct("tail", "until")).over(order))
    mixed = F.raise_error(F.concat(F.lit("lines of a split are not together: "), "file")).cast("boolean")
    new = F.when(F.col("before.until") > F.col("ord"), mixed).otherwise(~F.col("first") | F.coalesce(cut_between(F.col("before.tail"), F.col("head")), F.lit(True)))
    ends = ends.withColumn("k", F.sum(F.when(new, 1).otherwise(0)).over(order)).groupBy("file", "k")
    ends = ends.agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "raw"))).alias("held"))
    whole = ends.select("file", "ord", F.regexp_replace(F.array_join("held.raw", ""), r"^\s+", "").alias("raw"))
    return pieces.where("not first and not last").select("file", "ord", "raw").union(whole)


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one task's lines, in order; first and last say which ones may go on in other tasks.

    A run of lines is of one split and in order. The record that is open at a batch's end is held for the next one.
    """
    held: dict | None = None  # the open record: row of its first part, texts so far, its first and last part
    for batch in batches:
        file, block, seq, text, bare = parts_of(batch)
        n = len(text)
        if not n:
            continue
        offsets, data = np.frombuffer(bare.buffers()[1], np.int32)[bare.offset : bare.offset + n + 1], np.frombuffer(bare.buffers()[2], np.uint8)
        head, tail = data[offsets[:-1]], data[offsets[1:] - 1]
        lone = (np.diff(offsets) == 1) & (head == ord(","))
        turn, cut = np.ones(n, bool), np.ones(n, bool)
        together = (seq[1:] >= seq[:-1]) & (block[1:] == block[:-1]) & pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        turn[1:] = ~together
        cut[1:] = turn[1:] | cut_bytes(tail[:-1], lone[:-1], head[1:])
        if held:
            turn[0] = file[0].as_py() != held["file"] or block[0] != held["block"] or seq[0] <= held["until"]
            cut[0] = turn[0] or cut_bytes(held["tail"], held["lone"], head[:1])[0]
        starts = np.flatnonzero(cut)
        more = int(starts[0]) if len(starts) else n
        if more:  # the held record's further parts
            held["texts"].append(joined(text[:more], [0, more])[0])
            held |= {"tail": tail[more - 1 : more], "lone": lone[more - 1 : more], "until": seq[more - 1]}
        if not len(starts):
            continue
        if held:
            yield last_piece(held, bool(turn[starts[0]]))
        begin, end = starts[:-1], starts[1:]
        texts = joined(text, starts)
        first, last = turn[begin], turn[end]
        if len(begin):
            inner = pc.ascii_ltrim(texts[:-1], SPACE)
            raw = pc.if_else(pa.array(first | last), texts[:-1], inner) if (first | last).any() else inner
            yield pa.RecordBatch.from_arrays([file.take(pa.array(begin)), place(block[begin], seq[begin]), raw, pa.array(first), pa.array(last), shown(head[begin]), shown(tail[end - 1], lone[end - 1]), place(block[end - 1], seq[end - 1])], PIECE_NAMES)
        i = int(starts[-1])
        held = {"file": file[i].as_py(), "block": block[i], "seq": seq[i], "texts": [texts[-1]], "first": bool(turn[i]), "head": head[i : i + 1], "tail": tail[-1:], "lone": lone[-1:], "until": seq[-1]}
    if held:
        yield last_piece(held, True)


PIECE_NAMES = ["file", "ord", "raw", "first", "last", "head", "tail", "until"]


def last_piece(held: dict, last: bool) -> pa.RecordBatch:
    """The record that was held, as a row."""
    one = lambda x: np.array([x], np.int64)
    text = joined(pa.concat_arrays([pa.array([t.as_buffer().to_pybytes()], pa.binary()).view(pa.string()) for t in held["texts"]]), [0, len(held["texts"])])
    text = text if held["first"] or last else pc.ascii_ltrim(text, SPACE)
    return pa.RecordBatch.from_arrays([pa.array([held["file"]]), place(one(held["block"]), one(held["seq"])), text, pa.array([held["first"]]), pa.array([last]), shown(held["head"]), shown(held["tail"], held["lone"]), place(one(held["block"]), one(held["until"]))], PIECE_NAMES)


def place(block: np.ndarray, seq: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(block, pa.int64()), pa.array(seq, pa.int64())], ["block", "seq"])


def joined(texts: pa.Array, starts: list[int] | np.ndarray) -> pa.Array:
    """The texts from each start to the next, or to the end, as one."""
    stops = [*starts, len(texts)] if starts[-1] < len(texts) else starts
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), texts), "")


def shown(byte: np.ndarray, lone: np.ndarray | None = None) -> pa.Array:
    """A part's first or last byte as ``cut_between`` wants it: only a lone one stands alone."""
    text = [chr(x) if x < 128 else "x" for x in byte]
    return pa.array(text if lone is None else [t if x else f"x{t}" for t, x in zip(text, lone)])


def cut_bytes(last: np.ndarray, lone: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``cut_between`` for the last byte of each part, whether that is a lone comma, and the next part's first byte."""
    goes_on = np.isin(last, OPEN_AFTER) | np.isin(first, OPEN_BEFORE)
    return ~goes_on | ((first == ord("{")) & ((last == ord("{")) | ((last == ord(",")) & ~lone)))


def parts_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """File, block, seq, text and trimmed text of each part of the lines that is not blank; a line's first part begins with a line feed.

    A line without a closing brace but at its end is one part; only others are looked at one by one.
    """
    raw = pc.fill_null(batch.column("raw"), "")
    odd = np.flatnonzero(pc.count_substring(raw, "}").to_numpy() > pc.ends_with(raw, "}").to_numpy(zero_copy_only=False))
    at = np.arange(len(raw))
    lead = np.ones(len(raw), bool)
    if len(odd):
        found = [[p for p in PART.findall(x) if p] for x in raw.take(pa.array(odd)).view(pa.binary()).to_pylist()]
        counts = np.ones(len(raw), np.int64)
        counts[odd] = [len(f) for f in found]
        flat = pa.array([p for f in found for p in f], pa.binary()).view(pa.string())
        at = np.repeat(at, counts)
        firsts = np.cumsum(counts) - counts
        lead = np.zeros(len(at), bool)
        lead[firsts] = True
        source = at.copy()
        source[np.isin(at, odd)] = len(raw) + np.arange(len(flat))
        raw = pa.concat_arrays([raw, flat]).take(pa.array(source))
    bare = pc.ascii_trim(raw, SPACE)
    keep = pc.greater(pc.binary_length(bare), 0)
    text = pc.binary_join_element_wise(pc.if_else(pa.array(lead), "\n", ""), raw, "")
    kept = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
    at, order = at[kept], batch.column("ord")
    block, seq = (order.field(i).to_numpy(zero_copy_only=False)[at] for i in range(2))
    return batch.column("file").take(pa.array(at)), block, seq, text.take(pa.array(kept)), bare.take(pa.array(kept))


def read_json_pretty(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ord, raw): one whole JSON object a row, in whatever layout."""
    return as_records(read_lines(spark, paths))


def read_ds389_json(lines: DataFrame) -> DataFrame:
    """Adds rec, the object of each line; null where a line is none."""
    return lines.withColumn("rec", F.from_json("raw", DS389_JSON))
