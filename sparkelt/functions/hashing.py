"""Keyed and plain hashes as column expressions."""

import hashlib

from pyspark.sql import functions as F, types as T

BLOCK = 64  # SHA-256 block size in bytes
INNER, OUTER = 0x36, 0x5C  # HMAC pad bytes

HEX = "0123456789abcdef"
# Sixteen letters for derived keys. None of them equals a pad byte, so a
# padded key never holds a NUL character and stays plain text.
KEY_LETTERS = "ghijklmnopqrstuv"


def sha256(column):
    return F.sha2(column.cast("string"), 256)


def _xor(text, byte):
    return "".join(chr(ord(c) ^ byte) for c in text)


def _hmac(inner_key, outer_key, message):
    digest = F.unhex(F.sha2(F.concat(inner_key, message.cast("string").cast("binary")), 256))
    return F.sha2(F.concat(outer_key, digest), 256)


def hmac_sha256(message, key):
    """Hex HMAC-SHA256 of a column under one key (``str`` or ``bytes``)."""
    raw = key.encode() if isinstance(key, str) else key
    raw = hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw
    raw = raw.ljust(BLOCK, b"\0")
    pads = [F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (INNER, OUTER)]
    return _hmac(*pads, message)


def derived_key(master, scope):
    """A 64-letter key per value of ``scope`` (such as a tenant), derived from one master secret."""
    return F.translate(F.sha2(F.concat(F.lit(f"{master}:"), scope.cast("string")), 256), HEX, KEY_LETTERS)


def hmac_sha256_scoped(message, master, scope):
    """HMAC-SHA256 under the key that ``derived_key`` gives for each row's ``scope``."""
    key = derived_key(master, scope)
    pads = [F.translate(key, KEY_LETTERS, _xor(KEY_LETTERS, pad)).cast("binary")
            for pad in (INNER, OUTER)]
    return _hmac(*pads, message)


def _needs_form(kind):
    """Whether equal values of a type may have different JSON texts, or different values one text."""
    if isinstance(kind, T.StructType):
        return any(_needs_form(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _needs_form(kind.elementType)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.MapType, T.DoubleType, T.FloatType))


def _exact(value, kind):
    """A value in a form whose JSON text shows every difference, in any time zone, and no other.

    Instants become whole microseconds, local times their text, and maps their
    sorted entries, as two equal maps may list them in different orders. The
    negative zero of floats, which equals zero in joins and groups, becomes zero.
    """
    if not _needs_form(kind):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(
            _exact(e["key"], kind.keyType).alias("key"), _exact(e["value"], kind.valueType).alias("value"))))
    fields = [_exact(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def row_digest(df, columns):
    """SHA-256 hex of the named columns of a row: equal rows give equal digests, and only they."""
    values = [_exact(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*values)), 256)


def content_digest(digest):
    """Aggregates that identify a set of rows whatever their order: a count and two digest sums.

    Each sum adds 60-bit slices as DECIMAL, so partial sums merge exactly.
    """
    def total(start):
        piece = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(28,0)")
        return F.sum(piece).cast("decimal(38,0)")

    return [F.count("*").alias("row_count"), total(1).alias("sum_low"), total(16).alias("sum_high")]


def content_hash(row_count="row_count", sum_low="sum_low", sum_high="sum_high"):
    return F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in (row_count, sum_low, sum_high)]), 256)
