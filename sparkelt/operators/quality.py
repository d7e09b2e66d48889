"""Cleaning, de-duplication, quarantine and repeat detection."""

from functools import reduce

from pyspark.sql import Window, functions as F

from ..functions.hashing import content_digest, content_hash, row_digest
from ..sources.files import write_through
from ..sources.paths import shared_dir
from .relational import join_frames

# Texts that mean "no value".
NULL_WORDS = ("", "null", "n/a", "nan")


def normalise_nulls(df, columns=None, words=NULL_WORDS):
    """Turn the null words, whatever their case and outer blanks, into nulls in text columns."""
    texts = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    if not texts:
        return df
    return df.withColumns({
        c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*words), F.col(f"`{c}`")) for c in texts})


def try_cast_schema(df, schema):
    """The columns of ``schema`` in its types; a value that does not fit becomes null."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def dedup_by_key(df, keys, order, keep="first"):
    """One row per key: the first (or last) by ``order``, then by the other columns.

    Spark keeps one row per key in every task before the shuffle (a window
    group limit), so many copies of one key cost no more than one.
    """
    orderable = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    ranked = [c for c in order if c not in keys] + [c for c in orderable if c not in keys and c not in order]
    if not ranked:
        return df.dropDuplicates(list(keys))
    direction = F.asc if keep == "first" else F.desc
    parts = [F.col(f"`{k}`") for k in keys]
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*[direction(f"`{c}`") for c in ranked]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup_by_hash(df, columns, order, keep="first"):
    """One row per content: rows whose ``columns`` are equal, compared by their digest."""
    hashed = df.withColumn("_digest", row_digest(df, columns))
    return dedup_by_key(hashed, ["_digest"], order, keep).drop("_digest")


def _all_true(rules):
    return reduce(lambda a, b: a & b, [F.coalesce(rule, F.lit(False)) for rule in rules.values()])


def split_quarantine(df, rules):
    """``(good, bad)`` by named rules; a rule that is null counts as broken.

    Bad rows carry the names of their broken rules in ``errors``.
    """
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    good = df.where(_all_true(rules))
    bad = df.where(~_all_true(rules)).withColumn("errors", F.array_compact(F.array(*broken)))
    return good, bad


def reprocess(bad, repair, rules):
    """Repair quarantined rows and test them again; returns ``(good, still bad)``."""
    return split_quarantine(repair(bad.drop("errors")), rules)


# -- repeated batches -------------------------------------------------------

def batch_hashes(df, batch):
    """Content hash per batch, the same whatever the order of its rows."""
    digested = df.select(batch, row_digest(df, [c for c in df.columns if c != batch]).alias("_digest"))
    return digested.groupBy(batch).agg(*content_digest(F.col("_digest"))).select(
        batch, content_hash().alias("content_hash"))


def new_batches(incoming, ledger, batch):
    """Batches whose content neither the ledger nor an earlier incoming batch has.

    ``ledger`` has a column ``content_hash``. Returns ``(rows, entries)``: the
    accepted rows and the ledger entries (batch, content_hash) to append. The
    hashes, one row per batch, are written once to the shared folder.
    """
    hashes = write_through(batch_hashes(incoming, batch), shared_dir(incoming.sparkSession, "batches") + ".parquet")
    unseen = join_frames(hashes, ledger.select("content_hash"), "content_hash", "anti")
    entries = unseen.groupBy("content_hash").agg(F.min(batch).alias(batch)).select(batch, "content_hash")
    return join_frames(incoming, entries.select(batch), batch, "semi"), entries


# -- snapshots --------------------------------------------------------------

def append_version(df, path, version):
    """Add a snapshot as one partition of a versioned table; writing it again replaces it."""
    writer = df.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def latest_version(spark, path):
    """The newest snapshot; older partitions are pruned before the scan."""
    # one row per file, from the listing alone: the content is not read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    newest = files.agg(F.max("version")).scalar()
    return spark.read.parquet(path).where(F.col("version") == newest)
