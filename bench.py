"""Headline benchmark: prints one JSON line.

The events of ``$BENCH_SF_DIR`` are first written as log files in each format (not timed). Then decoding,
reports and exports over those files are timed, and the main catalogue queries over the tables. Each time
is the better of two runs, so that code generation is not counted.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog import aggregate, analyze, export, open_logs, stats
from tallylog.catalogue import render
from tallylog.catalogue.queries import QUERIES
from tallylog.plans import scratch_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
TABLE_QUERIES = (
    "parse_json_entries",
    "level_counts",
    "group_by_field",
    "top_ips",
    "top_errors",
    "numeric_stats_lineitem",
    "full_report",
    "filter_chain",
    "search_keyword",
    "filter_raw_regex",
    "detect_format_documents",
    "tail_n",
)


def consume(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def best(job: Callable[[], None]) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        job()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def write_logs(spark: SparkSession) -> dict[str, str]:
    facts = render.facts(render.table(spark, SF_DIR, "events"))
    makers = {"json": render.json_lines, "text": render.text_lines, "syslog": render.syslog_lines}
    paths = {}
    for fmt, make in makers.items():
        paths[fmt] = scratch_dir(spark, f"bench-{fmt}")
        make(facts).select("value").write.text(paths[fmt])
    paths["csv"] = scratch_dir(spark, "bench-csv")
    columns = F.from_csv("value", F.lit(", ".join(f"{name} string" for name in render.CSV_HEADER)), {"escape": '"'})
    lines = render.csv_lines(facts.where(~F.col("broken"))).select(columns.alias("r")).select("r.*")
    lines.write.csv(paths["csv"], header=True, escape='"')
    return paths


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tallylog-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    paths = write_logs(spark)
    logs = {fmt: open_logs(spark, path, fmt, default_year=2024) for fmt, path in paths.items()}
    lines = {fmt: logs[fmt].entries().count() for fmt in logs}

    queries: dict[str, float] = {}
    rates: dict[str, int] = {}
    for fmt, source in logs.items():
        queries[f"decode_{fmt}_files"] = best(lambda source=source: consume(source.entries()))
        rates[fmt] = round(lines[fmt] / queries[f"decode_{fmt}_files"])
    every = list(paths.values())
    queries["detect_files"] = best(lambda: open_logs(spark, every))
    queries["report_json_files"] = best(lambda: consume(aggregate(logs["json"], group_by="source", top_ips=10)))
    queries["stats_text_files"] = best(lambda: consume(stats(logs["text"])))
    queries["analyze_numbered_files"] = best(lambda: consume(analyze(logs["text"], level="ERROR")))
    queries["analyze_raw_regex_files"] = best(
        lambda: consume(analyze(logs["json"], regex='"user_id":1[0-9],', line_numbers=False))
    )
    queries["export_json_files"] = best(
        lambda: export(logs["json"], scratch_dir(spark, "bench-export"), "json", level="ERROR")
    )
    queries["export_csv_files"] = best(
        lambda: export(logs["json"], scratch_dir(spark, "bench-export"), "csv", filters=["status:^5"])
    )
    for name in TABLE_QUERIES:
        queries[name] = best(lambda name=name: consume(QUERIES[name](spark, SF_DIR)))

    result = {
        "metric": "total_seconds",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "lines_per_second": rates,
        "lines": lines,
        "cpus": int(CPUS),
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
