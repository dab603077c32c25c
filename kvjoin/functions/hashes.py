"""Bit-exact 32-bit hashes as column expressions on BIGINT (Spark has no unsigned type, and ANSI mode forbids wrap-around)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M32 = 1 << 32
POLYNOMIAL = 0xEDB88320  # reflected CRC-32
# Masks of the table hashes and the seed of the partition hash.
JOIN_MASK, LOCAL_MASK, GLB_SEED = 0xD9D65ADC, 0xBFD06116, 4
SLOTS = 4096


def crc_table() -> list[int]:
    """The standard table, by its rule."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


def _byte(k: Column, i: int) -> Column:
    return F.shiftright(k, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def _table(k: Column, mask: int) -> Column:
    t = F.array(*[F.lit(x).cast("long") for x in crc_table()])
    at = lambda i: F.element_at(t, _byte(k, i) + 1)
    return at(0).bitwiseAND(F.lit(mask)).bitwiseXOR(at(1)).bitwiseXOR(at(2)).bitwiseXOR(at(3))


def h_join(k: Column) -> Column:
    return _table(k, JOIN_MASK)


def h_local(k: Column) -> Column:
    return _table(F.shiftright(k, 6), LOCAL_MASK)


def _shl(a: Column, n: int) -> Column:
    """a << n modulo 2**32, for a below 2**32."""
    return F.shiftleft(a, n).bitwiseAND(F.lit(M32 - 1))


def _add(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(M32 - 1))


def _chain(df: DataFrame, name: str, first: Column, steps: list[Callable[[Column], Column]]) -> DataFrame:
    """df with name: first, then each step applied to it. A projection per step: every step reads its input more
    than once, so Catalyst keeps them apart and whole-stage code generation computes each once."""
    out = df.withColumn(name, first)
    for step in steps:
        out = out.withColumn(name, step(F.col(name)))
    return out


def _shifts(*steps: tuple[str, str, int]) -> list[Callable[[Column], Column]]:
    def one(op: str, way: str, n: int) -> Callable[[Column], Column]:
        def apply(h: Column) -> Column:
            y = _shl(h, n) if way == "<<" else F.shiftright(h, n)
            return h.bitwiseXOR(y) if op == "^" else _add(h, y)

        return apply

    return [one(*s) for s in steps]


def with_h_glb(df: DataFrame, key: str, name: str = "h_glb") -> DataFrame:
    """Partition hash: mixes the low, then the high 16 bits into a seed and finishes by shifts."""
    k = F.col(key)
    low, high = k.bitwiseAND(F.lit(0xFFFF)), F.shiftright(k, 16).bitwiseAND(F.lit(0xFFFF))
    mixed = lambda h: _shl(h, 16).bitwiseXOR(_shl(high, 11).bitwiseXOR(h))
    return _chain(df, name, low + F.lit(GLB_SEED), [mixed, *_shifts(("+", ">>", 11), ("^", "<<", 3), ("+", ">>", 5), ("^", "<<", 4), ("+", ">>", 17), ("^", "<<", 25), ("+", ">>", 6))])


def with_h_join2(df: DataFrame, key: str, name: str = "h_join2") -> DataFrame:
    """One-at-a-time over the four bytes."""
    steps: list[Callable[[Column], Column]] = []
    for i in range(4):
        steps += [lambda h, i=i: _add(h, _byte(F.col(key), i).cast("long")), *_shifts(("+", "<<", 10), ("^", ">>", 6))]
    return _chain(df, name, F.lit(0).cast("long"), [*steps, *_shifts(("+", "<<", 3), ("^", ">>", 11), ("+", "<<", 15))])


def h_double1(k: Column) -> Column:
    return k % SLOTS


def h_double2(k: Column) -> Column:
    return F.lit(7) - k % 7


# Tuple ids: rank (5 bits), bank (6 bits), index within the bank (21 bits).
def tid_create(rank: Column, bank: Column, index: Column) -> Column:
    return index.bitwiseOR(F.shiftleft(rank, 27)).bitwiseOR(F.shiftleft(bank, 21))


def tid_owner(tid: Column) -> Column:
    """rank * 64 + bank."""
    return F.shiftright(tid, 27).bitwiseAND(F.lit(31)) * 64 + F.shiftright(tid, 21).bitwiseAND(F.lit(63))


def tid_local(tid: Column) -> Column:
    return tid.bitwiseAND(F.lit(0x1FFFFF))


def tid_key_pack(tid: Column, key: Column) -> Column:
    """64 bits; a tid of 2**31 or more gives a negative BIGINT, as the bits say."""
    return F.shiftleft(tid, 32).bitwiseOR(key)


def tid_key_tid(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 32)


def tid_key_key(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(M32 - 1))


def packet_tid(packet: Column, index: Column) -> Column:
    return packet * 128 + 8 + index * 8


def lowest_bit(k: Column) -> Column:
    """Index of the lowest set bit; null for 0."""
    return F.when(k != 0, F.length(F.bin(k.bitwiseAND(-k))) - 1)
