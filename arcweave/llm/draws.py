"""Random draws that any engine with md5 can repeat: 52 bits of a digest, as a long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(2**52)
#: Upper 12 bits of a draw: the ranges that long orders are cut into.
RANGES = 4096


def draw(*parts: Column | int | str) -> Column:
    """A long in [0, 2^52) from the parts joined by colons; a null part is an empty one."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 13), 16, 10).cast("long")


def range_of(drawn: Column) -> Column:
    """The one of ``RANGES`` equal ranges, in ascending order, that a draw lies in."""
    return F.shiftright(drawn, 40).cast("int")


def draw_sql(*parts: str) -> str:
    """:func:`draw` in DuckDB SQL; the parts are SQL expressions."""
    return "('0x' || substr(md5(" + " || ':' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts) + "), 1, 13))::bigint"


def crc32_sql(text: str) -> tuple[str, str]:
    """(table of 256 remainders as a subquery with column f, expression that needs it) for the CRC-32 of a text in DuckDB SQL."""
    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: xor(c >> 1, 3988292384 * (c & 1)))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::bigint)"
    return f"(select {table} as f)", f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), lambda a, b: xor(a >> 8, f[1 + (xor(a, b) & 255)])))"
