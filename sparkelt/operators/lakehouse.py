"""Bronze, silver and gold tables with their catalog."""

import time
import uuid
from functools import reduce

from pyspark.sql import Window, functions as F, types as T

from ..functions.privacy import mask_table, personal_columns
from .profile import rollup_first, rollup_sums
from .relational import join_frames

# Stages and the fields of a catalog entry.
STAGES = ("BRONZE", "SILVER", "GOLD")

ENTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.IntegerType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("format_type", T.StringType()),
    T.StructField("size_kb", T.DoubleType()),
    T.StructField("path", T.StringType()),
])


class Lakehouse:
    """Tables under ``base/<stage>/<name>/<snapshot>``, listed in ``base/_catalog``.

    A registration writes a new snapshot and then its catalog entry, so a
    reader sees the old table or the new one and never half of one.
    """

    def __init__(self, spark, base):
        self.spark, self.base = spark, base.rstrip("/")

    def _check(self, name, stage):
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; there are {STAGES}")
        if not name or "/" in name or name in (".", ".."):
            raise ValueError(f"not a table name: {name!r}")

    def register(self, name, stage, df):
        """Store a table and return its catalog entry as a one-row DataFrame."""
        self._check(name, stage)
        path = f"{self.base}/{stage.lower()}/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        # counted from the written footers, and right even when a task ran twice
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        entry = (name, stage, rows, len(df.columns), df.columns, time.time(), "columnar/parquet",
                 round(_stored_bytes(self.spark, path) / 1024, 2), path)
        stored = self.spark.createDataFrame([entry], ENTRY)
        stored.coalesce(1).write.mode("append").parquet(f"{self.base}/_catalog")
        return stored

    def entries(self, stage=None):
        """The latest entry of every table, or of every table of one stage."""
        try:
            log = self.spark.read.schema(ENTRY).parquet(f"{self.base}/_catalog")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            log = self.spark.createDataFrame([], ENTRY)
        if stage:
            log = log.where(F.col("stage") == stage)
        latest = log.groupBy("name", "stage").agg(F.max_by(F.struct(*ENTRY.names), "created_at").alias("e"))
        return latest.select("e.*")

    def get(self, stage, name):
        """The registered table, or None."""
        self._check(name, stage)
        found = self.entries(stage).where(F.col("name") == name).select("path").first()
        return self.spark.read.parquet(found["path"]) if found else None

    def transition(self, stage, name, to_stage, to_name, change=None):
        """Register a table in another stage, passed through ``change`` if given."""
        table = self.get(stage, name)
        if table is None:
            raise KeyError(f"no table {name!r} in {stage}")
        return self.register(to_name, to_stage, table.transform(change) if change else table)

    def promote_bronze(self, df, name="raw_ingest"):
        return self.register(name, "BRONZE", df)

    def promote_silver(self, df, name="cleansed_silver", strict=False, salt=None):
        """Mask the personal columns, found by name."""
        return self.register(name, "SILVER", to_silver(df, strict, salt))

    def promote_gold(self, df, name="gold_aggregates", first_only=False, order=None):
        return self.register(name, "GOLD", rollup_first(df, order) if first_only else rollup_sums(df))


def _stored_bytes(spark, path):
    # lists the files; their content is not read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def to_silver(df, strict=False, salt=None):
    return mask_table(df, **personal_columns(df.columns, strict), salt=salt)


# -- gold marts -------------------------------------------------------------

def star_join(fact, dimensions):
    """Denormalise a fact table; ``dimensions`` holds (table, key) pairs with unique keys.

    Catalyst broadcasts the dimensions that are small enough; adaptive
    execution splits the fact's hot keys for the others.
    """
    return reduce(lambda wide, d: join_frames(wide, d[0], d[1]), dimensions, fact)


def with_ranks(mart, within, by):
    """Rank the rows of an aggregated mart inside each group, highest value first.

    For marts whose groups are small, such as one row per period.
    """
    window = Window.partitionBy(*within).orderBy(*[F.col(c).desc() for c in by])
    return mart.withColumn("rank", F.rank().over(window))


def with_running_totals(mart, within, order, value, span=7):
    """Running total and moving average of an aggregated mart, per group in the given order."""
    upto = Window.partitionBy(*within).orderBy(*order)
    running = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = upto.rowsBetween(1 - span, Window.currentRow)
    return mart.withColumns({
        "running_total": F.sum(value).over(running),
        "moving_average": F.avg(F.col(value).cast("double")).over(recent),
    })
