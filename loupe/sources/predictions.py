"""Prediction-run tables (S15-S17): one header row per run and one row per scored key.

Storage is two Parquet tables; the row table is partitioned by ``run_id`` so reading one run
prunes partitions, and appends from concurrent runs never rewrite old files.
"""

from __future__ import annotations

import datetime as dt
import getpass
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_SCHEMA = ("run_id int, catalog_name string, table_name string, column_names string, test_run boolean, "
                 "class_rate_type string, class_labels string, class_algorithm string, class_time timestamp, "
                 "class_script string, class_user string")
RATE_TYPES = ("U", "A", "I")  # fixed values


def header_frame(spark: SparkSession, run_id: int, table_name: str, column_names: list[str], rate_type: str,
                 labels: list[str], algorithm: str, catalog: str = "spark_catalog", test_run: bool = False,
                 script: str = "loupe") -> DataFrame:
    row = (int(run_id), catalog, table_name, ",".join(column_names), bool(test_run), rate_type, ",".join(labels),
           algorithm, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), script, _user())
    return spark.createDataFrame([row], HEADER_SCHEMA)


def _user() -> str:
    try:
        return getpass.getuser()
    except Exception:  # noqa: BLE001
        return "unknown"


def rows_frame(results: DataFrame, run_id: int) -> DataFrame:
    """Rows: run_id, unique_key (bigint), class_result, class_rate, class_probabilities."""
    return results.select(F.lit(int(run_id)).alias("run_id"), F.col("unique_key").cast("bigint").alias("unique_key"),
                          "class_result", F.col("class_rate").cast("double").alias("class_rate"),
                          "class_probabilities")


def next_run_id(spark: SparkSession, header_path: str) -> int:
    """Supplied or max(run_id) + 1 (1 for a new table)."""
    if not _exists(spark, header_path):
        return 1
    m = spark.read.parquet(header_path).agg(F.max("run_id").alias("m")).first()["m"]
    return 1 if m is None else int(m) + 1


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def write_run(header: DataFrame, rows: DataFrame, base_path: str) -> dict:
    """Append header and rows (creating the tables when missing); returns run id, row
    count and the retrieval query text."""
    run_id = header.first()["run_id"]
    header.write.mode("append").parquet(os.path.join(base_path, "header"))
    rows.write.mode("append").partitionBy("run_id").parquet(os.path.join(base_path, "rows"))
    n = rows.sparkSession.read.parquet(os.path.join(base_path, "rows")).filter(F.col("run_id") == run_id).count()
    query = (f"SELECT * FROM parquet.`{os.path.join(base_path, 'rows')}` r JOIN parquet.`{os.path.join(base_path, 'header')}` h "
             f"USING (run_id) WHERE run_id = {run_id}")
    return {"run_id": run_id, "row_count": n, "query": query}


def check_predictions(header: DataFrame, rows: DataFrame) -> DataFrame:
    """Violation counts of the table constraints, one row per check (all zero when valid)."""
    checks = [
        ("bad_rate", rows.filter(~(((F.col("class_rate") >= 0) & (F.col("class_rate") <= 1)) | (F.col("class_rate") == -1)))),
        ("bad_rate_type", header.filter(~F.col("class_rate_type").isin(*RATE_TYPES))),
        ("duplicate_keys", rows.groupBy("run_id", "unique_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")),
        ("orphan_runs", rows.select("run_id").distinct().join(header.select("run_id"), "run_id", "left_anti")),
    ]
    out = None
    for name, bad in checks:
        c = bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")
        out = c if out is None else out.unionByName(c)
    return out
