"""Parts of DuckDB queries that state results of more than one operator."""

#: A table of 256 values by crc32's bitwise definition.
CRC_TABLE = """
bits(b, k, v) as (select b, 0, cast(b as bigint) from range(256) r(b)
  union all select b, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as (select list(v order by b) as crc_of from bits where k = 8)"""


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, one step of the table for each byte; ``tab`` must be joined."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(substr({text}, i, 1)) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"
