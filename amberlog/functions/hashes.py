"""String codes as expressions: a 32-bit hash on low bytes, and a code of the first four characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of the four-character code, 7 bits each; characters outside count as the first one.
ALPHABET = "!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHJKLMNOPQRSTUWXYZ[\\]^_`{|}~АБВГДЕЖЗИЙКЛМНОПРСТУФКЦЧШЩЪЫЬЭЮЯЁ"
_WORD = (1 << 32) - 1


def _units(s: Column) -> Column:
    """The UTF-16 units of a string, as numbers."""
    pairs = F.regexp_replace(F.hex(F.encode(s, "UTF-16BE")), "(.{4})", "$1 ")
    return F.transform(F.filter(F.split(pairs, " "), lambda u: u != ""), lambda u: F.conv(u, 16, 10).cast("bigint"))


def low_byte_hash(s: Column | str) -> Column:
    """Each unit's low byte is added, then the word turned left by 13 bits is taken off, modulo 2^32; as a signed int.  Null gives null."""
    s = F.col(s) if isinstance(s, str) else s

    def add(h: Column, unit: Column) -> Column:
        x = (h + unit.bitwiseAND(F.lit(255))) % (1 << 32)
        turned = F.shiftleft(x, 13).bitwiseAND(F.lit(_WORD)).bitwiseOR(F.shiftright(x, 19))
        return F.pmod(x - turned, F.lit(1 << 32))

    h = F.aggregate(_units(s), F.lit(0).cast("bigint"), add)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def first4_code(s: Column | str) -> Column:
    """The places of the first four characters (padded by blanks, upper case) in ALPHABET, 7 bits each; null gives null."""
    s = F.col(s) if isinstance(s, str) else s
    code = F.lit(0)
    for i in range(4):
        c = F.substring(F.rpad(F.upper(s), F.greatest(F.length(s), F.lit(4)), F.lit(" ")), i + 1, 1)
        code = code * 128 + F.greatest(F.instr(F.lit(ALPHABET), c) - 1, F.lit(0))
    return code.cast("int")
