"""Pieces of DuckDB SQL that several operators' oracles share."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, from its definition: eight steps a bit at a time for each byte."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    bits = "list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b))"
    return f"xor(list_reduce({byte}, lambda a, b: {bits}, 4294967295), 4294967295)"
