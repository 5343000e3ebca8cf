"""Integer hashes with wrap-around arithmetic, as Column expressions that ANSI mode accepts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF
# Fixed values of the 32-bit hash, in order of use.
HASH32_CONSTANTS = (0x7ED55D16, 0xC761C23C, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, by halves that can't overflow."""
    low = a.bitwiseAND(LOW) + b.bitwiseAND(LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(LOW))


def xor_shift(k: Column, n: int) -> Column:
    return k.bitwiseXOR(F.shiftrightunsigned(k, n))


def hash64shift(key: Column) -> Column:
    """A 64-bit mix, signed."""
    add_shift = lambda n: lambda k: add64(k, F.shiftleft(k, n))
    k = let(key.cast("long"), lambda k: add64(F.bitwise_not(k), F.shiftleft(k, 21)))
    k = let(k, lambda k: xor_shift(k, 24))
    k = let(k, lambda k: add64(add64(k, F.shiftleft(k, 3)), F.shiftleft(k, 8)))
    k = let(k, lambda k: xor_shift(k, 14))
    k = let(k, lambda k: add64(add64(k, F.shiftleft(k, 2)), F.shiftleft(k, 4)))
    k = let(k, lambda k: xor_shift(k, 28))
    return let(k, add_shift(31))


def unsigned_mod(h: Column, n: Column) -> Column:
    """h as an unsigned long, modulo n < 2**62."""
    return F.when(h >= 0, h % n).otherwise((F.shiftrightunsigned(h, 1) % n * 2 + h.bitwiseAND(1)) % n)


def random_index(key: Column, n: Column) -> Column:
    return let(hash64shift(key), lambda h: unsigned_mod(h, n))


def hash32(a: Column) -> Column:
    """A 32-bit mix of the low 32 bits; an unsigned value in a long."""
    c = HASH32_CONSTANTS
    low = lambda x: x.bitwiseAND(LOW)
    a = let(low(a.cast("long")), lambda a: low(a + c[0] + F.shiftleft(a, 12)))
    a = let(a, lambda a: a.bitwiseXOR(F.lit(c[1])).bitwiseXOR(F.shiftright(a, 19)))
    a = let(a, lambda a: low(a + c[2] + F.shiftleft(a, 5)))
    a = let(a, lambda a: low(a + c[3]).bitwiseXOR(low(F.shiftleft(a, 9))))
    a = let(a, lambda a: low(a + c[4] + F.shiftleft(a, 3)))
    return let(a, lambda a: a.bitwiseXOR(F.lit(c[5])).bitwiseXOR(F.shiftright(a, 16)))


def hash_int(a: Column) -> Column:
    return hash32(a).bitwiseAND(0x7FFFFFFF)


def hash_double(a: Column) -> Column:
    """In [0, 1)."""
    return hash_int(a).cast("double") / float(1 << 31)


def linear_congruence(a: Column) -> Column:
    return (((a * 1103515245).bitwiseAND(LOW) + 12345).bitwiseAND(LOW)) % LOW


def sdbm(text: Column) -> Column:
    """String hash over signed bytes, h * 65599 + c, in 32 bits."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    starts = F.sequence(F.lit(0), F.octet_length(text) - 1)
    byte = lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    folded = F.aggregate(starts, F.lit(0).cast("long"), lambda h, i: (h * 65599 + signed(byte(i))).bitwiseAND(LOW))
    return F.when(F.octet_length(text) == 0, F.lit(0).cast("long")).otherwise(folded)


# The same on whole numbers of Python, for driver-side folds and tests.


def hash64shift_int(key: int) -> int:
    m = (1 << 64) - 1
    k = key & m
    k = (~k + (k << 21)) & m
    k ^= k >> 24
    k = k * 265 & m
    k ^= k >> 14
    k = k * 21 & m
    k ^= k >> 28
    k = (k + (k << 31)) & m
    return k - (1 << 64) if k >> 63 else k


def hash32_int(a: int) -> int:
    c = HASH32_CONSTANTS
    a &= LOW
    a = a + c[0] + (a << 12) & LOW
    a = a ^ c[1] ^ a >> 19
    a = a + c[2] + (a << 5) & LOW
    a = (a + c[3] & LOW) ^ (a << 9 & LOW)
    a = a + c[4] + (a << 3) & LOW
    return a ^ c[5] ^ a >> 16
