"""Database tables and read-only queries over JDBC."""

from ..functions.validation import check_read_query
from .paths import table_name


def jdbc_url(engine, database, host="localhost", port=None, custom=None):
    """Address of a database; the forms and ports are fixed values."""
    if custom:
        return custom
    if engine in ("postgresql", "mysql"):
        port = port or {"postgresql": 5432, "mysql": 3306}[engine]
        return f"jdbc:{engine}://{host}:{port}/{database}"
    if engine == "sqlite":
        return f"jdbc:sqlite:{database}"
    raise ValueError(f"give a custom URL for engine {engine!r}")


def connection_options(url, user=None, password=None, driver=None, fetchsize=10_000):
    options = {"url": url, "user": user, "password": password, "driver": driver,
               "fetchsize": str(fetchsize)}
    return {k: v for k, v in options.items() if v is not None}


def split_options(column, lower, upper, partitions):
    """Options that spread a table scan over ``partitions`` range queries on ``column``."""
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions)}


def read_jdbc(spark, options, tenant, key, split=None):
    """Scan a tenant's table; filters and column pruning are pushed to the database.

    One task reads it all unless ``split`` (see ``split_options``) names a column to divide it by.
    """
    reader = spark.read.format("jdbc").options(**options)
    return reader.options(dbtable=table_name(tenant, key), **(split or {})).load()


def read_jdbc_query(spark, options, query):
    """Run one read-only statement in the database; one task takes its result, so it should be small."""
    return spark.read.format("jdbc").options(**options).option("query", check_read_query(query)).load()


def write_jdbc(df, options, tenant, key, mode="overwrite", connections=8):
    """Write a tenant's table; ``connections`` bounds the load on the database."""
    target = {**options, "dbtable": table_name(tenant, key), "numPartitions": str(connections)}
    df.write.format("jdbc").options(**target).mode(mode).save()
