"""String semantics that differ from the SQL defaults: white space, UTF-16 lengths, plurals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts see it, in Java's and RE2's syntax.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters for Python.
SPACE_CHARS = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{SPACE}+", " "))


def units(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))


def truncated(c: Column, most: int) -> Column:
    flat = collapsed(c)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
