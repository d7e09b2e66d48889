"""Capacity units, cost avoidance and size classes of runs and tables."""

from pyspark.sql import functions as F, types as T

# Fixed values of the capacity model.
EMBEDDED, DISTRIBUTED = "TIER_0_EMBEDDED", "TIER_1_SPARK"
BASELINE_UNITS = "2.50"
EMBEDDED_RATE = "0.01"
USD_PER_UNIT_SECOND = "0.00005"
ROW_THRESHOLD = 50_000
MEMORY_CEILING_MB = 1024.0
SMALLEST_MB = 0.01


def _dec(value, kind="decimal(10,5)"):
    return F.lit(value).cast(kind)


def capacity_columns(runs, tier="tier", memory_mb="memory_mb", duration_ms="duration_ms"):
    """Add capacity units, their Spark equivalent, the cost avoided and the governor's action.

    All in DECIMAL, so that rounding does not depend on the binary value.
    """
    ms = F.col(duration_ms).cast("decimal(12,2)")
    mb = F.col(memory_mb).cast("decimal(12,3)")
    seconds = F.greatest(ms * _dec("0.001", "decimal(4,3)"), _dec("0.001", "decimal(17,5)"))
    embedded = F.col(tier) == EMBEDDED
    load = F.greatest(mb * _dec("0.1", "decimal(2,1)"), _dec("1", "decimal(15,4)"))
    small = F.round(seconds * load * _dec(EMBEDDED_RATE, "decimal(3,2)"), 5)
    floor = F.greatest(seconds, _dec("1", "decimal(17,5)"))
    baseline = _dec(BASELINE_UNITS, "decimal(3,2)")
    equivalent = F.when(embedded, F.round(floor * baseline, 3)).otherwise(F.round(seconds * baseline, 3))
    units = F.when(embedded, small).otherwise(F.round(seconds * baseline, 3))
    spared = (F.col("spark_equivalent_cu") - F.col("capacity_units")).cast("decimal(14,5)")
    usd = spared * seconds.cast("decimal(12,5)") * _dec("0.005", "decimal(4,3)")  # 100 x the unit price
    text = F.regexp_replace(F.col("spark_equivalent_cu").cast("string"), r"\.?0+$", "")
    return (
        runs.withColumns({
            "capacity_units": units.cast("decimal(18,5)"),
            "spark_equivalent_cu": equivalent.cast("decimal(18,3)"),
        })
        .withColumns({
            "cost_avoidance_usd": F.when(embedded, F.greatest(F.round(usd, 4), _dec("0", "decimal(5,4)")))
            .otherwise(0).cast("decimal(18,4)"),
            # fixed values: the action texts
            "governor_action": F.when(embedded, F.concat(F.lit("ECONOMIC_TIER_0 (Saved "), text, F.lit(" CU)")))
            .otherwise("SCALED_TO_DISTRIBUTED_SPARK"),
        })
    )


def capacity_documented(rows, seconds, tier):
    """The documented formula: million rows x minutes for the distributed tier, 0 for the embedded one."""
    units = rows.cast("double") / 1_000_000 * (seconds.cast("double") / 60)
    return F.when(tier == EMBEDDED, 0.0).otherwise(F.greatest(units, F.lit(0.0)))


def tier_column(rows, size_mb, preferred=None, row_threshold=ROW_THRESHOLD, ceiling_mb=MEMORY_CEILING_MB):
    """Embedded below both limits unless Spark is asked for; else distributed."""
    fits = (rows < row_threshold) & (size_mb < ceiling_mb)
    if preferred is not None:
        fits &= F.lower(F.coalesce(preferred, F.lit(""))) != "pyspark"
    return F.when(fits, EMBEDDED).otherwise(DISTRIBUTED)


def size_bound_flag(size_mb, ceiling_mb=MEMORY_CEILING_MB):
    """Whether a table is over twice the ceiling."""
    return size_mb > 2 * ceiling_mb


FIXED_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
               T.DateType: 4}


def row_bytes(df):
    """Bytes of one row: text and binary by length, numbers by width, other types by their text."""
    fixed, sized = 0, []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sized.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sized.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)))
        else:
            fixed += FIXED_WIDTH.get(type(field.dataType), 8)
    return sum((s.cast("long") for s in sized), F.lit(fixed).cast("long"))


def size_estimate(df):
    """One row: rows, columns, bytes and megabytes (0.01 for an empty table)."""
    totals = df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"))
    mb = F.round(F.col("bytes").cast("decimal(24,0)") / F.lit(1024 * 1024), 3).cast("double")
    return totals.select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), "bytes",
        F.when(F.col("row_count") == 0, SMALLEST_MB).otherwise(mb).alias("size_mb"))
