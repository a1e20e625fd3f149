"""A wide run: orders repeated to about a million rows, 60 checked fields, 52 of them encoded.

usage: python tools/wide_run.py [sf_dir] [copies]

Prints the time of all stages plus the export. Every field is derived from the order, a third of
the rows share one key and another third have none.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def wide_list(orders, copies):
    from pyspark.sql import functions as F

    rows = orders.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    n = F.col("o_orderkey") * copies + F.col("copy")
    key = (
        F.when(F.col("o_orderstatus") == "F", "hot@example.com")
        .when(F.col("o_orderstatus") == "O", None)
        .otherwise(F.concat(F.lit("Customer"), "o_custkey", F.lit("@example.com")))
    )
    labels = [
        F.concat(F.lit(" Label "), ((F.col("o_custkey") + i) % (20 + i)).cast("string")).alias(f"label {i}")
        for i in range(52)
    ]
    return rows.select(
        (n + 1).alias("_row_num"),
        key.alias("email"),
        F.concat(F.lit("13"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("mobile"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.col("o_custkey").cast("string").alias("units"),
        F.col("o_orderpriority").alias("priority"),
        F.concat_ws(" ", "o_orderkey", "o_orderpriority", "o_orderstatus").alias("remark"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit("name")).alias("name"),
        *labels,
    )


def main():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from rollcall import FieldRule, FieldSpec, export_run, run_lists
    from rollcall.sources.lists import spread

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 7
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="wide-run-")
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    primary = wide_list(orders, copies)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        (F.col("c_custkey") + 1).alias("_row_num"),
        F.concat(F.lit("customer"), "c_custkey", F.lit("@EXAMPLE.com")).alias("email"),
    )
    entries = spark.range(52 * 50).select(
        F.concat(F.lit("D"), (F.col("id") / 50).cast("int").cast("string")).alias("dict_id"),
        F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("code"),
        F.concat(F.lit("Label "), (F.col("id") % 50).cast("string")).alias("label"),
        F.concat(F.lit("label "), (F.col("id") % 50).cast("string")).alias("label_key"),
        F.col("id").alias("ord"),
    )
    spec = FieldSpec.of(
        [
            FieldRule("name", required=True),
            FieldRule("email", max_length=60),
            FieldRule("mobile"),
            FieldRule("day", type="date"),
            FieldRule("amount", type="小数"),
            FieldRule("units", type="int"),
            FieldRule("priority", regex="^[1-5]-"),
            FieldRule("remark", max_length=30),
            *[FieldRule(f"label {i}", required=True, dict_id=f"D{i}", max_length=12) for i in range(52)],
        ]
    )
    started = time.time()
    done = run_lists({"primary": primary, "partner": customers}, spec, entries, key="email", work_dir=folder + "/work")
    print("planned and stored: %.1f s" % (time.time() - started), [s.status for s in done.stages], flush=True)
    written = export_run(done, folder + "/out", timestamp="t")
    print("exported: %.1f s" % (time.time() - started), flush=True)
    data = spark.read.parquet(written["primary"] + "/data")
    print("rows", data.count(), "columns", len(data.columns))
    for r in spark.read.parquet(written["primary"] + "/summary").orderBy("pos").collect():
        print("  ", r["statistic"], r["value"])


if __name__ == "__main__":
    main()
