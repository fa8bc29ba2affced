"""Times headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from dirlog import queries
from dirlog.fixtures import render_openldap
from dirlog.operators import operations as O
from dirlog.operators.stats import cost_by_account
from dirlog.plans.events import parse_openldap
from dirlog.session import tuned

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("cost_by_account", "operation_counts", "errors_per_account", "filter_families", "operation_sequences", "connections", "concurrency_series", "top_consumer_per_hour", "top_operations")


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tuned(spark)
    table = spark.read.parquet(f"{SF_DIR}/events.parquet")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(render_openldap(table).limit(1000))
    found = queries.queries()
    times = {name: timed(lambda n=name: noop(found[n](spark, SF_DIR))) for name in HEADLINE}

    # Rates on lines that are there already, as a reader of logs has them.
    lines = {h: render_openldap(table, h).repartition(int(CPUS)).persist() for h in ("rfc3339-utc", "syslog")}
    n = lines["rfc3339-utc"].count()
    lines["syslog"].count()
    parse = {h: min(timed(lambda h=h: noop(parse_openldap(lines[h], h, 2024))) for _ in range(2)) for h in lines}
    events = parse_openldap(lines["rfc3339-utc"], "rfc3339-utc", 2024)
    cold = timed(lambda: noop(cost_by_account(O.build_operations(events))))
    cached = events.persist()
    cached.agg(F.count("*")).collect()
    warm = timed(lambda: noop(cost_by_account(O.build_operations(cached))))
    rates = {"lines": n, "parse_rfc3339_lines_per_s": round(n / parse["rfc3339-utc"]), "parse_syslog_lines_per_s": round(n / parse["syslog"]), "syslog_to_rfc3339": round(parse["rfc3339-utc"] / parse["syslog"], 2), "cost_by_account_lines_per_s": round(n / cold), "cost_by_account_cached_lines_per_s": round(n / warm)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "rates": rates}))


if __name__ == "__main__":
    main()
