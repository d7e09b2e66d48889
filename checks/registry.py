"""The registry and what the queries share."""

from pyspark.sql import functions as F

from sparkelt.sources.files import read_dataset
from sparkelt.sources.paths import shared_dir

ENTRIES = {}


def query(name, sql=None):
    """Register a callable (spark, sf_dir) under a name, with its SQL twin."""
    def add(function):
        if name in ENTRIES:
            raise ValueError(f"registered twice: {name}")
        ENTRIES[name] = (function, sql)
        return function
    return add


def table(spark, sf, name):
    return read_dataset(spark, f"{sf}/{name}.parquet")


def money(df, *columns):
    """Columns of amounts as DECIMAL, whose sums do not depend on the order of the rows."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def scratch(spark, purpose):
    return shared_dir(spark, purpose)


# -- SQL snippets -----------------------------------------------------------

def dec(column):
    return f"CAST({column} AS DECIMAL(18,2))"


def total(column):
    return f"CAST(SUM({dec(column)}) AS DOUBLE)"


def half_up_mean(column):
    """Mean of non-negative amounts, rounded half up to 2 in whole numbers."""
    cents = f"CAST(SUM({dec(column)}) * 100 AS HUGEINT)"
    return f"CAST((2 * {cents} + COUNT({column})) // (2 * COUNT({column})) AS DOUBLE) / 100"
