"""One transform, measured: its result, a capacity report and a signed record."""

import time

from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..operators.audit import sign
from ..operators.capacity import DISTRIBUTED, capacity_columns, size_estimate
from ..operators.conditions import safe_filter
from ..sources.files import write_through
from .sql import sql_transform

RUN = ("timestamp double, tenant_id string, project_id string, user_id string, engine string, code string, "
       "row_count long, column_count int, memory_mb double, duration_ms double, tier string, status string, "
       "error string")
ENGINES = {"sql": sql_transform, "filter": safe_filter}


def run_transform(df, engine, code, tenant, project="default", user="default", function=None, limit=100,
                  order=None, path=None, log_path=None):
    """Run a transform and describe the run.

    ``engine`` is ``sql``, ``filter`` or ``function`` (then ``function`` is a
    callable and ``code`` its text). Returns ``(result, sample, record)``:
    the lazy result, at most ``limit`` rows of it, and one row with status,
    size, capacity and signature. A failed transform gives no result and a
    record with the redacted error. With ``path`` the result is written there
    and measured and returned as written, so that it is computed once. With
    ``log_path`` the record is appended to the run log there (Parquet) and read back.
    """
    spark = df.sparkSession
    begun, stamp = time.perf_counter(), time.time()
    result = sample = None
    rows, columns, megabytes, error = 0, 0, 0.0, None
    try:
        if engine == "function":
            result = df.transform(function)
        elif engine in ENGINES:
            result = ENGINES[engine](df, code)
        else:
            raise ValueError(f"unknown engine {engine!r}")
        if path:
            result = write_through(result, path)
        size = size_estimate(result).first()
        rows, columns, megabytes = size["row_count"], size["column_count"], size["size_mb"]
        sample = (result.orderBy(*order) if order else result).limit(limit)
    except Exception as problem:
        result, error = None, str(problem)
    took = (time.perf_counter() - begun) * 1000
    run = (stamp, tenant, project, user, engine, code, rows, columns, megabytes, took, DISTRIBUTED,
           "failed" if error else "succeeded", error)
    measured = capacity_columns(spark.createDataFrame([run], RUN))
    # a failed run has used nothing that is billed
    units = F.when(F.col("status") == "failed", 0).otherwise(F.col("capacity_units"))
    measured = measured.withColumn("capacity_units", units.cast("decimal(18,5)"))
    report = measured.select("timestamp", "column_count", "memory_mb", "tier", "spark_equivalent_cu",
                             "cost_avoidance_usd", "governor_action",
                             F.when(F.col("error").isNotNull(), redact(F.col("error"), strict=True)).alias("error"))
    record = sign(measured).join(report, "timestamp")
    if log_path:
        record.write.mode("append").parquet(log_path)
        record = spark.read.schema(record.schema).parquet(log_path).where(F.col("timestamp") == stamp)
    return result, sample, record
