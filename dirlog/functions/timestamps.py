"""Times of every header shape as nanoseconds since the epoch, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names of the log formats.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
NS = 1_000_000_000
ZONE = r"(?:Z|[+-]\d{2}:?\d{2})$"
DEBUG = r"^([0-9a-f]{1,15})\.([0-9a-f]{1,15})$"


def seconds(c: Column, pattern: str) -> Column:
    """Seconds since the epoch of a time that ends in Z or +hhmm; null where there is no such time."""
    return F.unix_seconds(F.try_to_timestamp(c, F.lit(f"{pattern}XX")))


def fraction(c: Column) -> Column:
    """Nanoseconds of the decimal fraction in a time; digits past the ninth are cut."""
    return F.substring(F.rpad(F.regexp_extract(c, r"\.(\d+)", 1), 9, "0"), 1, 9).cast("long")


def from_rfc3339(c: Column) -> Column:
    """With T or a blank between day and time, any fraction, and Z, +hh:mm, +hhmm or (as Z) no zone, a blank before it or not."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\.\d+| (?=[+-])|(?<=[+-]\d{2}):(?=\d{2}$)", ""), " ", "T")
    any_zone = seconds(F.when(plain.rlike(ZONE), plain).otherwise(F.concat(plain, F.lit("Z"))), "yyyy-MM-dd'T'HH:mm:ss") * NS + fraction(c)
    # The usual case, UTC, needs no pattern; a cast keeps six digits of the fraction.
    utc = F.unix_micros(c.try_cast("timestamp")) * 1000 + F.when(F.length(c) > 27, F.pmod(fraction(c), F.lit(1000))).otherwise(0)
    return F.when(F.endswith(c, F.lit("Z")), utc).otherwise(any_zone)


def from_bracketed(c: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS with or without fraction, and an offset."""
    return seconds(F.regexp_replace(c, r"\.\d+| ", ""), "d/MMM/yyyy:HH:mm:ss") * NS + fraction(c)


def from_syslog(c: Column, year: int, tz: str = "UTC") -> Column:
    """A time without year; with a zone other than UTC the offset of that very instant counts."""
    local = seconds(F.concat(F.lit(f"{year} "), F.regexp_replace(c, r"\s+", " "), F.lit("Z")), "yyyy MMM d HH:mm:ss")
    if tz != "UTC":
        local = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), tz))
    return local * NS


def from_debug(c: Column) -> Column:
    """Hexadecimal seconds and fraction: eight digits or more are nanoseconds, fewer are microseconds."""
    frac = F.regexp_extract(c, DEBUG, 2)
    return F.conv(F.nullif(F.regexp_extract(c, DEBUG, 1), F.lit("")), 16, 10).cast("long") * NS + F.conv(frac, 16, 10).cast("long") * F.when(F.length(frac) >= 8, 1).otherwise(1000)


#: Which reader takes which format.
BY_FORMAT = {from_debug: ("debug",), from_rfc3339: ("rfc3339-utc", "rfc3339", "ol26", "389ds-json"), from_bracketed: ("389ds", "opendj", "opendj-errors")}


def to_epoch_ns(c: Column, fmt: Column | str, year: int, tz: str = "UTC", formats: tuple[str, ...] | None = None) -> Column:
    """Nanoseconds since the epoch of the time ``c`` of a header of the format ``fmt``; null where it cannot be read.

    ``formats`` says which can occur, if not all can.
    """
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    can = lambda *names: formats is None or bool({*names} & {*formats})
    out = F.when(F.lit(False), F.lit(None).cast("long"))
    for reader, names in BY_FORMAT.items():
        if can(*names):
            out = out.when(fmt.isin(*names), reader(c))
    if can("syslog-localtime"):
        out = out.when(fmt == "syslog-localtime", from_syslog(c, year, tz))
    return out.when(fmt.isin("syslog", "syslog-utc"), from_syslog(c, year)) if can("syslog", "syslog-utc") else out


def div(x: Column, by: int) -> Column:
    """Whole division that rounds down."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def to_ts(ns: Column) -> Column:
    """Microsecond timestamp."""
    return F.timestamp_micros(div(ns, 1000))


def format_timestamp(ns: Column, style: str = "rfc3339", raw: Column | None = None) -> Column:
    """rfc3339 (nanoseconds), iso8601 (seconds), minute, syslog, epoch (s.ns) or preserve (``raw`` as it was), in UTC."""
    sec = div(ns, NS)
    nano = F.pmod(ns, F.lit(NS))
    day = F.date_from_unix_date(div(sec, 86400).cast("int"))
    rest = F.pmod(sec, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", div(rest, 3600), F.pmod(div(rest, 60), F.lit(60)), F.pmod(rest, F.lit(60)))
    known = F.when(ns.isNotNull(), F.lit(True))
    if style == "rfc3339":
        out = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("."), F.format_string("%09d", nano), F.lit("Z"))
    elif style == "iso8601":
        out = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))
    elif style == "minute":
        out = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.substring(clock, 1, 5))
    elif style == "syslog":
        out = F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.lpad(F.dayofmonth(day).cast("string"), 3, " "), F.lit(" "), clock)
    elif style == "epoch":
        out = F.concat(sec.cast("string"), F.lit("."), F.format_string("%09d", nano))
    elif style == "preserve" and raw is not None:
        return raw
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.when(known, out)
