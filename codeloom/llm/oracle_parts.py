"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

#: One row, ``tab``: the 256 entries of the reflected CRC-32 table.
CRC_TABLE = """crc_table as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab
  from range(256) t(i))"""


def crc32(text: str) -> str:
    """Unsigned crc32 of a string's UTF-8 bytes; ``tab`` must be in scope."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1])), 4294967295)"
