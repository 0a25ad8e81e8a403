"""CRC-32 in DuckDB SQL, which has no function of that name, for the oracles of queries whose contract uses it."""

from __future__ import annotations

#: One row: the 256 remainders of the reflected polynomial, as the list ``t``.
CRC_TABLE = """
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))"""


def crc32_sql(text: str) -> str:
    """Expression of the unsigned CRC-32 of an ASCII string, with ``t`` of ``CRC_TABLE`` in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), "
            "lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)")
