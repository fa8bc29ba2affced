"""Who costs what and how: filter families, sequences of operations, hourly cost and takeovers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dirlog.functions.filters import generalize_filter, is_slow_filter, normalize_filter, op_symbol
from dirlog.functions.timestamps import NS, div
from dirlog.operators.operations import completed
from dirlog.operators.ranking import keep_top
from dirlog.operators.stats import MONEY, share, shared, time_sum, with_filter_key
from dirlog.schema import CONN


def templated(operations: DataFrame) -> DataFrame:
    """Completed operations with template. The helper keeps the templates it has made, so a repeated filter costs a look-up."""
    rows = completed(operations)
    return rows.withColumn("template", generalize_filter(normalize_filter(F.col("filter"))))


def filter_families(operations: DataFrame) -> DataFrame:
    """Per (account, template): count, time, average and entries.

    Equal filters of an account are added up before the template's helper sees them, and once more by template.
    """
    by = with_filter_key(completed(operations)).groupBy(F.col("who").alias("account"), "filter")
    by = by.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("etime").cast(MONEY)), F.lit(0)).alias("t"), F.sum("nentries").alias("e"), F.min("nentries").alias("lo"), F.max("nentries").alias("hi"))
    rows = by.withColumn("template", generalize_filter("filter")).groupBy("account", "template")
    out = rows.agg(F.sum("n").alias("n"), time_sum("t").alias("etime_total"), F.coalesce(F.sum("e"), F.lit(0)).alias("entries"), F.min("lo").alias("entries_min"), F.max("hi").alias("entries_max"))
    return out.withColumn("etime_avg", F.round(F.col("etime_total") / F.col("n"), 6))


def family_cost(families: DataFrame) -> DataFrame:
    return families.groupBy("template").agg(F.sum("n").alias("n"), time_sum("etime_total").alias("etime_total"))


def hogs_of(families: DataFrame, total: DataFrame, min_share: float = 20.0) -> DataFrame:
    """Families of slow filters that hold at least ``min_share`` percent of ``total`` (one row: all)."""
    rows = families.where(is_slow_filter(F.col("template"))).join(F.broadcast(total))
    rows = rows.where((F.col("all") > 0) & (F.col("etime_total") * 100 >= F.col("all") * min_share))
    return rows.select("account", "template", "n", "etime_total", share(F.col("etime_total"), F.col("all")).alias("share"))


def resource_hogs(operations: DataFrame, min_share: float = 20.0) -> DataFrame:
    """The same of operations, all time included: what has no filter counts in the total. Operations are read once.

    One grouping by (account, filter) gives both the families and the total.
    """
    by = completed(operations).groupBy(F.col("who").alias("account"), normalize_filter(F.col("filter")).alias("filter"))
    by = by.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("etime").cast(MONEY)), F.lit(0)).alias("t"))
    rows = by.withColumn("template", generalize_filter("filter")).groupBy("account", "template").agg(F.sum("n").alias("n"), time_sum("t").alias("etime_total"))
    everything, part = shared(rows)
    rows = everything.where(is_slow_filter(F.col("template")) & (F.col("_all") > 0) & (F.col("etime_total") * 100 >= F.col("_all") * min_share))
    return rows.select("account", "template", "n", "etime_total", part.alias("share"))


def etime_by_hour(operations: DataFrame) -> DataFrame:
    """(hour since the epoch, account) to time spent."""
    rows = completed(operations).where("end_ts_ns is not null")
    return rows.groupBy(div(F.col("end_ts_ns"), 3600 * NS).alias("hour"), F.col("who").alias("account")).agg(time_sum("etime").alias("etime_total"))


def top_consumer_per_hour(by_hour: DataFrame) -> DataFrame:
    """The busiest account of each hour; ties go to the smallest name."""
    best = F.min(F.struct((-F.col("etime_total")).alias("t"), "account"))
    return by_hour.groupBy("hour").agg(best.alias("b")).select("hour", "b.account", (-F.col("b.t")).alias("etime_total"))


def consumers_over_time(by_hour: DataFrame, keep: int = 6) -> DataFrame:
    """Time per hour of the accounts with the most in all, the others as one."""
    rows = by_hour.withColumn("etime_total", F.col("etime_total").cast(MONEY))
    return keep_top(rows, keep, "account", "etime_total", by=["hour"]).withColumn("etime_total", F.col("etime_total").cast("double"))


def onsets(top: DataFrame, win: int = 24, after: float = 0.8, before: float = 0.2, keep: int = 2) -> DataFrame:
    """Accounts that come to lead: most of the next ``win`` hours seen and few of those before; at least half of each must be there.

    The first such hour of each account, moved to the account's first leading hour in it; the best by gain, in
    order of time. Works on one row an hour.
    """
    w = Window.orderBy("hour")
    hours = top.select("hour", "account", (F.row_number().over(w) - 1).alias("i"))
    ahead, back = w.rowsBetween(0, win - 1), w.rowsBetween(-win, -1)
    near = hours.withColumns({"next": F.collect_list(F.struct("hour", "account")).over(ahead), "past": F.collect_list("account").over(back)})
    who = near.where((F.size("next") * 2 >= win) & (F.size("past") * 2 >= win)).select("i", "hour", "next", "past", F.explode(F.array_distinct(F.transform("next", lambda x: x["account"]))).alias("account"))
    led = F.filter("next", lambda x: x["account"] == F.col("account"))
    who = who.withColumns({"lead": F.size(led) / F.size("next"), "led": F.size(F.filter("past", lambda x: x == F.col("account"))) / F.size("past"), "start": F.array_min(F.transform(led, lambda x: x["hour"]))})
    hits = who.where((F.col("lead") >= after) & (F.col("led") <= before))
    first = hits.groupBy("account").agg(F.min_by(F.struct("start", (F.col("lead") - F.col("led")).alias("gain")), "i").alias("f"))
    best = first.select("account", F.col("f.start").alias("hour"), F.round("f.gain", 6).alias("gain")).orderBy(F.desc("gain"), "hour", "account").limit(keep)
    return best.orderBy("hour", "account")


def operation_sequences(operations: DataFrame, max_len: int = 4) -> DataFrame:
    """(account, sequence, length, n): runs of 2 to ``max_len`` operations that follow each other on a connection.

    The account is that of the last operation. Runs are counted in each task before they are shuffled.
    """
    rows = templated(operations).withColumn("symbol", op_symbol(F.col("type"), F.col("template"), F.col("scope")))
    w = Window.partitionBy(*CONN).orderBy("end_ord")
    rows = rows.select(F.col("who").alias("account"), F.collect_list("symbol").over(w.rowsBetween(1 - max_len, 0)).alias("run"))
    grams = F.transform(F.sequence(F.lit(2), F.size("run")), lambda n: F.struct(F.array_join(F.slice("run", F.size("run") - n + 1, n), " > ").alias("sequence"), n.alias("length")))
    return rows.where(F.size("run") >= 2).select("account", F.explode(grams).alias("g")).groupBy("account", "g.sequence", "g.length").agg(F.count("*").alias("n"))
