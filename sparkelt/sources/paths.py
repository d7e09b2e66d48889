"""Tenant-scoped names for datasets, views and tables."""

import re
import tempfile
import uuid


def scoped_key(tenant, key, project=None):
    """``tenant[/project]/key``; refuses empty parts and path traversal."""
    tenant = (tenant or "").strip()
    project = (project or "").strip().lstrip("/")
    key = (key or "").strip().lstrip("/")
    if not tenant:
        raise ValueError("a tenant is required")
    if not key:
        raise ValueError("a dataset key is required")
    for name in (tenant, project):
        if "/" in name:
            raise ValueError(f"no slash in a tenant or project: {name!r}")
    parts = [p for p in (tenant, project, key) if p]
    for part in parts:
        if {".", ".."} & set(part.split("/")):
            raise ValueError(f"path traversal is not allowed: {part!r}")
    return "/".join(parts)


def scoped_path(base, tenant, key, project=None):
    return f"{base.rstrip('/')}/{scoped_key(tenant, key, project)}"


def object_store_path(bucket, tenant, key, project=None, prefix="", scheme="s3a"):
    """``scheme://bucket/[prefix/]tenant/[project/]key``."""
    if not bucket:
        raise ValueError("a bucket is required")
    prefix = prefix.strip("/")
    base = f"{scheme}://{bucket}" + (f"/{prefix}" if prefix else "")
    return scoped_path(base, tenant, key, project)


def table_name(tenant, key, project=None):
    """Database table for a dataset key: ``tenant__key`` or ``tenant__project__key``.

    Different datasets have different tables: what is not a letter or digit is
    written as an underscore and the hex code of its bytes. A name that starts
    with a digit gets its code too, so that it needs no quotes.
    """
    scoped_key(tenant, key, project)
    parts = [p for p in (tenant.strip(), (project or "").strip().lstrip("/"), key.strip().lstrip("/")) if p]
    plain = [re.sub(r"[^A-Za-z0-9]", lambda m: "".join(f"_{b:02x}" for b in m[0].encode()), p) for p in parts]
    if plain[0][0].isdigit():
        plain[0] = f"_{ord(plain[0][0]):02x}{plain[0][1:]}"
    return "__".join(plain)


_local_root = None


def shared_dir(spark, purpose):
    """A fresh path for a written table that every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a
    local master, where driver and executors are one machine, may go without.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="sparkelt-")
        root = _local_root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def remove(spark, path):
    """Delete a path that ``shared_dir`` gave, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
