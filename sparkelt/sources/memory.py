"""Named tables of a session, kept apart by tenant and project."""

from .paths import scoped_key


def _view(tenant, key, project):
    return "`mem:" + scoped_key(tenant, key, project).replace("`", "``") + "`"


def write_memory(df, tenant, key, project=None):
    """Name a DataFrame; it stays lazy, nothing is collected."""
    df.createOrReplaceTempView(_view(tenant, key, project))


def read_memory(spark, tenant, key, project=None):
    name = _view(tenant, key, project)
    if not spark.catalog.tableExists(name):
        raise KeyError(f"no such table for this tenant: {scoped_key(tenant, key, project)}")
    return spark.table(name)
