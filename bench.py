"""Prints one JSON line: seconds of the headline operations, each the median of warm runs, on local[$BENCH_CPUS].

csv_*: a generated file of 1,000,000 rows (id, k, score, name, flag; k has 50 values), read from text each time, with
types from its first 65,536 rows. table_*: lineitem and orders of $BENCH_SF_DIR. Results go to the noop sink, but for
csv_copy, which writes a file.
"""

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from millrace import AggSpec, Pipeline
from millrace.sources import sinks

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "1000000"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        print(json.dumps(run(spark, folder)))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


def run(spark: SparkSession, folder: str) -> dict:
    path, small = f"{folder}/t.csv", f"{folder}/small.csv"
    data = spark.range(ROWS).selectExpr("id", "id % 50 AS k", "round((id * 7919 % 100003) / 100.0, 2) AS score", "concat('name_', id) AS name", "id % 2 = 0 AS flag")
    sinks.write_csv(data, path)
    sinks.write_csv(spark.range(50).selectExpr("id AS k", "concat('group_', id) AS label"), small)

    def csv() -> Pipeline:
        return Pipeline(spark).read_csv(path, multi_line=False, infer_rows=65_536).telemetry(False)

    def table(name: str) -> Pipeline:
        return Pipeline(spark).read_parquet(f"{SF_DIR}/{name}.parquet")

    groups = [AggSpec("sum", "score"), AggSpec("avg", "score"), AggSpec("count_all")]
    prices = [AggSpec("sum", "l_quantity"), AggSpec("avg", "l_discount"), AggSpec("count_all")]
    makers = {
        "csv_read": csv,
        "csv_filter": lambda: csv().filter("score > 500"),
        "csv_map": lambda: csv().map({"doubled": "score * 2"}),
        "csv_select": lambda: csv().select(["id", "score", "name"]),
        "csv_aggregate": lambda: csv().aggregate(["k"], groups),
        "csv_dedup": lambda: csv().dedup(["name"]),
        "csv_join": lambda: csv().join_csv(small, ["k"], ["k"]),
        "csv_copy": lambda: csv().write_csv(f"{folder}/copy.csv"),
        "csv_sort": lambda: csv().sort(["score"]),
        "table_filter": lambda: table("lineitem").filter("l_quantity > 45 and l_discount < 0.05"),
        "table_map": lambda: table("lineitem").map({"revenue": "l_extendedprice * (1 - l_discount)"}),
        "table_select": lambda: table("lineitem").select(["l_orderkey", "l_quantity", "l_shipdate"]),
        "table_aggregate": lambda: table("lineitem").aggregate(["l_returnflag", "l_linestatus"], prices),
        "table_dedup": lambda: table("lineitem").dedup(["l_orderkey"]),
        "table_join": lambda: table("lineitem").select(["l_orderkey", "l_quantity"]).join(table("orders").select(["o_orderkey", "o_custkey"]), ["l_orderkey"], ["o_orderkey"]),
        "table_top_k": lambda: table("orders").sort(["o_totalprice"], descending=True).limit(100),
        "table_sort": lambda: table("lineitem").sort(["l_extendedprice"]),
        "table_sample": lambda: table("lineitem").sample(0.1, "l_orderkey", 7),
    }
    seconds = {}
    for name, make in makers.items():
        times = []
        for _ in range(RUNS + 1):
            begun = time.perf_counter()
            make().execute()
            times.append(time.perf_counter() - begun)
        seconds[name] = round(median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr)
    csv_names = [n for n in seconds if n.startswith("csv_")]
    rates = {n: round(ROWS / seconds[n]) for n in csv_names}
    return {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "csv_rows": ROWS, "csv_rows_per_sec": rates, "cpus": int(CPUS)}


if __name__ == "__main__":
    main()
