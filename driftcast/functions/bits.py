"""Bit fields, codes, checksums and layouts as Column expressions on longs, strings of 0/1 and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def to_bits(v: Column, n: int) -> Column:
    """The n low bits of a value as a string of 0 and 1, most significant first."""
    return F.lpad(F.bin(v.cast("long").bitwiseAND(F.lit((1 << n) - 1))), n, "0")


def from_bits(bits: Column) -> Column:
    """The value of a string of 0 and 1 (at most 62 of them); null for an empty one."""
    return F.conv(F.when(F.length(bits) > 0, bits), 2, 10).cast("long")


def signed(v: Column, n: int) -> Column:
    """An n-bit field as two's complement."""
    return F.when(v >= (1 << (n - 1)), v - (1 << n)).otherwise(v)


def bit_length(v: Column) -> Column:
    return F.length(F.bin(v))


def exp_golomb(v: Column, k: int = 0) -> Column:
    """Exponential Golomb code of order k: v + 2**k after as many zeros as it has bits beyond k + 1."""
    x = v + (1 << k)
    return F.concat(F.repeat(F.lit("0"), bit_length(x) - F.lit(k + 1)), F.bin(x))


def exp_golomb_length(v: Column, k: Column | int = 0) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return 2 * bit_length(v + F.expr("1L") * F.pow(F.lit(2), k).cast("long")) - 1 - k


def exp_golomb_read(bits: Column, k: int = 0) -> Column:
    """The value at the start of a string of bits."""
    zeros = F.instr(bits, "1") - 1
    return F.conv(F.substring(bits, zeros + 1, zeros + F.lit(k + 1)), 2, 10).cast("long") - (1 << k)


def fold(v: Column) -> Column:
    """Signed to unsigned: 0, 1, -1, 2, -2 to 0, 1, 2, 3, 4."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def unfold(u: Column) -> Column:
    return F.when(u % 2 == 1, F.floor((u + 1) / 2)).otherwise(-F.floor(u / 2)).cast("long")


def _divided(value: int, width: int, poly: int) -> int:
    """The remainder that the four top bits of a register leave."""
    for _ in range(4):
        value = (value << 1) ^ (poly if value >> (width - 1) & 1 else 0)
        value &= (1 << width) - 1
    return value


def crc(value: Column, bits: int, width: int) -> Column:
    """CRC from 0 of the low bits of a value, first bit first: polynomial 3 for 4 bits, 7 for 8 bits.

    bits is a multiple of 4; four of them are taken at once through a table of 16 remainders.
    """
    if bits % 4:
        raise ValueError("the number of bits must be a multiple of 4")
    table = F.array(*[F.lit(_divided(k << (width - 4), width, {4: 0x3, 8: 0x07}[width])) for k in range(16)])
    reg, value = F.lit(0), value.cast("long")
    for shift in range(bits - 4, -4, -4):
        feed = F.shiftright(reg, width - 4).bitwiseXOR(F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(15)).cast("int"))
        found = F.element_at(table, feed + 1)
        reg = found.bitwiseXOR(F.shiftleft(reg, 4).bitwiseAND(F.lit((1 << width) - 1))) if width > 4 else found
    return reg


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit values, without passing 64 bits."""
    low = b.bitwiseAND(F.lit(0xFFFF))
    high = F.shiftrightunsigned(b, 16).bitwiseAND(F.lit(0xFFFF))
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK32))


def mulberry32(seed: Column, n: Column) -> Column:
    """The n-th draw (from 1) of the generator with this seed, in [0, 1): the state after n draws is known at once."""
    seed, n = seed.cast("long"), n.cast("long")
    step = imul(n.bitwiseAND(F.lit(MASK32)), F.lit(0x6D2B79F5).cast("long"))
    a = (seed + step).bitwiseAND(F.lit(MASK32))
    t = imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    u = (t + imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK32))
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def gauss(u: Column, v: Column) -> Column:
    """A normal draw from two uniform ones."""
    return F.sqrt(-2 * F.log(u + 1e-12)) * F.cos(2 * F.pi() * v)


def lcg(seed: Column, mult: int = 1103515245, add: int = 12345, mask: int = 0x7FFFFFFF) -> Column:
    """One step of a linear congruential generator."""
    return (imul(seed, F.lit(mult).cast("long")) + add).bitwiseAND(F.lit(mask))


def rgb565(r: Column, g: Column, b: Column) -> Column:
    """Three values from 0 to 255 in 16 bits."""
    def part(v: Column, top: int) -> Column:
        return F.floor(v * top / 255 + 0.5).cast("int")

    return F.shiftleft(part(r, 31), 11).bitwiseOR(F.shiftleft(part(g, 63), 5)).bitwiseOR(part(b, 31))


def rgb565_parts(code: Column) -> tuple[Column, Column, Column]:
    return (F.shiftright(code, 11).bitwiseAND(F.lit(31)) * 255 / 31, F.shiftright(code, 5).bitwiseAND(F.lit(63)) * 255 / 63,
            code.bitwiseAND(F.lit(31)) * 255 / 31)


def aspect_code(w: Column, h: Column) -> Column:
    """1 to 255 for width over height between 1/4 and 4."""
    return (1 + F.floor((F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.log2(w / h))) + 2) / 4 * 254 + 0.5)).cast("int")


def aspect_ratio(code: Column) -> Column:
    return F.when(code == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), (code - 1) / 254 * 4 - 2))


def torn(new: Column, old: Column, m: Column) -> Column:
    """The first m places of the new string and the rest of the old one."""
    return F.concat(F.substring(new, F.lit(1), m.cast("int")), F.substring(old, m.cast("int") + 1, F.length(old)))


def pattern_byte(seq: Column, j: Column) -> Column:
    """The test pattern that counts: byte j of packet seq."""
    return (seq + 37 * j).bitwiseAND(F.lit(255))
