"""Pieces of DuckDB SQL that several operators' SQL share."""

from __future__ import annotations

#: A table of the bytes' remainders by the polynomial of CRC-32, as the only row of `tab`.
CRC_TABLE = "tab AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i)))"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, given `tab`."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {octets}, lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"
