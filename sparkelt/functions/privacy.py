"""Masks and pseudonyms. A null stays null."""

from pyspark.sql import functions as F

from .hashing import hmac_sha256_scoped


def mask_email(column, style="short"):
    """``john.doe@acme.com`` to ``j***@acme.com``; text without ``@`` is left as it is.

    ``style="ends"`` also keeps the last letter of the local part (``j***e@acme.com``).
    """
    parts = F.split(column, "@")
    local, domain = parts[0], F.get(parts, F.lit(1))
    kept = F.concat(F.substring(local, 1, 1), F.lit("***"))
    if style == "ends":
        kept = F.concat(kept, F.right(local, F.lit(1)))
    masked = F.concat(F.when(F.length(local) <= 1, "*").otherwise(kept), F.lit("@"), domain)
    return F.when(column.contains("@"), masked).otherwise(column)


def mask_phone(column, style="short"):
    """``***-***-`` and the last four digits, ``****`` below four digits.

    ``style="prefix"`` keeps a leading country code (``+1-***-***-4567``).
    """
    digits = F.regexp_replace(column, r"(?U)\D", "")
    masked = F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))
    if style == "prefix":
        code = F.regexp_extract(column, r"^\s*(\+[0-9]{1,3})[^0-9]", 1)
        masked = F.when(code != "", F.concat(code, F.lit("-"), masked)).otherwise(masked)
    return F.when(F.length(digits) < 4, F.when(column.isNotNull(), "****")).otherwise(masked)


def mask_card(column):
    """Card and id numbers: fixed stars and the last four digits."""
    digits = F.regexp_replace(column, "[^0-9]", "")
    return F.when(F.length(digits) < 4, "****").when(
        digits.isNotNull(), F.concat(F.lit("****-****-****-"), F.right(digits, F.lit(4))))


def pseudonymize(column, salt, digits=12):
    """``pseudo_`` and the first hex digits of SHA-256 over ``salt:value``; equal values stay joinable.

    12 digits are the published form; among some ten million values two may
    share one, so ask for more (64 at most) where pseudonyms are join keys.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), column.cast("string")), 256)
    return F.concat(F.lit("pseudo_"), F.substring(digest, 1, digits))


def pseudonymize_scoped(column, master, scope, digits=64):
    """Pseudonym under the tenant's own key: joinable inside a tenant, not across tenants."""
    return F.concat(F.lit("pseudo_"), F.substring(hmac_sha256_scoped(column, master, scope), 1, digits))


def mask_table(df, email=(), phone=(), pseudonymous=(), salt=None):
    """Mask the named columns that exist in ``df``; the others pass through."""
    if pseudonymous and salt is None:
        raise ValueError("pseudonyms need a salt")
    changed = {c: mask_email(F.col(f"`{c}`").cast("string")) for c in email if c in df.columns}
    changed |= {c: mask_phone(F.col(f"`{c}`").cast("string")) for c in phone if c in df.columns}
    changed |= {c: pseudonymize(F.col(f"`{c}`"), salt) for c in pseudonymous if c in df.columns}
    return df.withColumns(changed) if changed else df


def personal_columns(columns, strict=False):
    """Columns to mask, by name, as keyword arguments for ``mask_table``.

    The loose rule looks for a word anywhere in the name; the strict rule
    takes exact names and also marks identifiers as pseudonymous. The names are fixed values.
    """
    if strict:
        return {
            "email": [c for c in columns if c == "email"],
            "phone": [c for c in columns if c == "phone"],
            "pseudonymous": [c for c in columns if c in ("ssn", "customer_id", "patient_id")],
        }
    lowered = {c: c.lower() for c in columns}
    return {
        "email": [c for c, name in lowered.items() if "email" in name],
        "phone": [c for c, name in lowered.items() if "phone" in name or "contact" in name],
    }


def encrypt(column, key):
    """AES-GCM, base64 text; an empty text stays empty. ``key`` is 16, 24 or 32 bytes."""
    sealed = F.base64(F.aes_encrypt(column, F.lit(key), F.lit("GCM")))
    return F.when(column == "", "").otherwise(sealed)


def decrypt(column, key):
    opened = F.aes_decrypt(F.unbase64(column), F.lit(key), F.lit("GCM")).cast("string")
    return F.when(column == "", "").otherwise(opened)
