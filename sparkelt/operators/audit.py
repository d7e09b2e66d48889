"""Signed run records and table fingerprints."""

from pyspark.sql import functions as F

from ..functions.hashing import content_digest, content_hash, hmac_sha256, row_digest, sha256

FIELDS = ("timestamp", "tenant_id", "project_id", "user_id", "engine", "code_hash", "row_count",
          "duration_ms", "capacity_units", "status")
# Numbers enter the signature as DECIMAL text, which every engine prints alike.
AS_TEXT = {"timestamp": "decimal(20,6)", "row_count": "decimal(20,0)",
           "duration_ms": "decimal(20,2)", "capacity_units": "decimal(20,4)"}


def _parts():
    return [F.col(f).cast(AS_TEXT.get(f, "string")).cast("string") for f in FIELDS]


def _signature(key):
    """The published form joins the fields with colons. The keyed form also gives
    each field's length, so that no field can hold the next one, and tells a null from an empty text."""
    if not key:
        return sha256(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in _parts()]))
    framed = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in _parts()]
    return hmac_sha256(F.concat_ws(":", *framed), key)


def sign(runs, key=None):
    """Run rows (the fields above, with the text in ``code``) as signed records.

    Duration is rounded to 2 and capacity to 4 decimals. Without a key the
    signature is the SHA-256 of the fields, which anyone can make; with one it is their HMAC.
    """
    rounded = runs.withColumns({
        "code_hash": sha256(F.col("code")),
        "duration_ms": F.col("duration_ms").cast("decimal(20,2)"),
        "capacity_units": F.col("capacity_units").cast("decimal(20,4)"),
    })
    return rounded.select(*FIELDS, _signature(key).alias("manifest_signature"))


def verify(records, key=None):
    """The records with ``valid``: whether the signature still fits the fields; a missing one does not."""
    return records.withColumn("valid", _signature(key).eqNullSafe(F.col("manifest_signature")))


def lineage_signature(input_hash, output_hash, code, key):
    """HMAC over input, output and code hashes: changed data or code no longer fits it."""
    return hmac_sha256(F.concat(input_hash, output_hash, sha256(code)), key)


def fingerprint(df):
    """One row that identifies the rows of a table in any order: count, two sums and their hash."""
    digests = df.select(row_digest(df, df.columns).alias("_digest"))
    return digests.agg(*content_digest(F.col("_digest"))).select(
        "row_count", "sum_low", "sum_high", content_hash().alias("content_hash"))
