"""The order-preserving key codec, as columns: bytes compare as the values do.

Unsigned integers are big-endian, signed ones have their sign bit flipped, strings and bytes stay as
they are.  In a tuple all but the last of the strings and bytes are framed: 00 becomes 00 FF, and
00 01 ends them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import KeyTooLong, TidemarkError

LONGEST = 1 << 16
_WIDTHS = {f"{s}{w}": (w, s == "i") for s in "ui" for w in (8, 16, 32, 64, 128)}


@dataclass(frozen=True)
class KeyPart:
    """One component of a key: u8 to u128, i8 to i128, string or bytes."""

    column: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in (*_WIDTHS, "string", "bytes"):
            raise TidemarkError(f"no key type {self.kind}")

    @property
    def fixed(self) -> bool:
        return self.kind in _WIDTHS


def _hex_of(col: Column, kind: str) -> Column:
    if kind == "string":
        return F.hex(F.encode(col, "UTF-8"))
    if kind == "bytes":
        return F.hex(col)
    width, signed = _WIDTHS[kind]
    if width == 128:  # held as its 16 encoded bytes
        return F.hex(col)
    n = col.cast("long")
    if width == 64:
        n = n.bitwiseXOR(F.lit(-(1 << 63))) if signed else n
    elif signed:
        n = n + F.lit(1 << (width - 1))
    return F.lpad(F.hex(n), width // 4, "0")


def _pairs(h: Column) -> Column:
    """Hex digits with a blank after each byte, so that patterns match whole bytes."""
    return F.regexp_replace(h, "(..)", "$1 ")


def frame(h: Column) -> Column:
    return F.concat(F.replace(F.replace(_pairs(h), F.lit("00 "), F.lit("00 FF ")), F.lit(" "), F.lit("")), F.lit("0001"))


def encode_hex(parts: list[tuple[Column, str]]) -> Column:
    """The encoded key in upper-case hex; null if any part is."""
    out = []
    for i, (col, kind) in enumerate(parts):
        h = _hex_of(col, kind)
        out.append(h if kind in _WIDTHS or i == len(parts) - 1 else frame(h))
    whole = F.concat(*out)
    return F.when(F.length(whole) > 2 * LONGEST, F.raise_error(F.lit("KeyTooLong: a key has more than 64 KiB"))).otherwise(whole)


def encode(parts: list[tuple[Column, str]]) -> Column:
    return F.unhex(encode_hex(parts))


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(21,0)")


def decode_hex(h: Column, kinds: list[str]) -> list[Column]:
    """The components of encoded keys, u64 and i64 as longs, 128-bit ones as bytes."""
    out, rest = [], h
    for i, kind in enumerate(kinds):
        if kind in _WIDTHS:
            width, signed = _WIDTHS[kind]
            digits = width // 4
            part, rest = F.substring(rest, 1, digits), F.substr(rest, F.lit(digits + 1))
            if width == 128:
                out.append(F.unhex(part))
                continue
            big = F.conv(part, 16, 10).cast("decimal(20,0)")
            if signed:
                out.append((big - _big(1 << (width - 1))).cast("long"))
            elif width == 64:
                out.append(F.when(big >= _big(1 << 63), big - _big(1 << 64)).otherwise(big).cast("long"))
            else:
                out.append(big.cast("long"))
            continue
        if i < len(kinds) - 1:
            pairs = _pairs(rest)
            framed = F.regexp_extract(pairs, "^((?:(?!00 01 ).. )*?(?:00 FF (?:(?!00 01 ).. )*?)*)00 01 ", 1)
            size = F.length(F.replace(framed, F.lit(" "), F.lit("")))
            part = F.replace(F.replace(framed, F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit(""))
            rest = F.substr(rest, size + F.lit(5))
        else:
            part = rest
        out.append(F.decode(F.unhex(part), "UTF-8") if kind == "string" else F.unhex(part))
    return out


def wide(value: int, signed: bool = False) -> bytes:
    """The 16 bytes of a u128 or i128."""
    low, high = (-(1 << 127), 1 << 127) if signed else (0, 1 << 128)
    if not low <= value < high:
        raise TidemarkError("beyond 128 bits")
    return (value - low).to_bytes(16, "big")


def check_length(encoded: bytes) -> bytes:
    if len(encoded) > LONGEST:
        raise KeyTooLong(f"a key has {len(encoded)} bytes")
    return encoded
