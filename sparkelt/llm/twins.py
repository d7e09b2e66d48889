"""Pieces of DuckDB SQL that several twins share."""

#: One row with the 256 remainders of CRC-32, worked out from its polynomial; join it to where ``crc32_sql`` is used.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n:
    list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders)"""


def crc32_sql(text):
    """Unsigned CRC-32 of an ASCII text; ``remainders`` of ``CRC_TABLE`` must be in reach."""
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    step = "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"
