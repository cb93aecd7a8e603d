"""Stable key hashes as native expressions.

A row's key is encoded as CBOR (an open array of the table name and one [name, value]
pair for each key column, sorted by name) and hashed by 64-bit FNV-1. The 64-bit product
would overflow, so the hash is kept as two 32-bit limbs in 64-bit integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of FNV-1, 64 bits: the offset basis as two limbs; the prime is 2 ** 40 + 435.
SEED_HI, SEED_LO, PRIME_LOW = 3421674724, 2216829733, 435
LIMB = (1 << 32) - 1
SIGN = 1 << 63


def _byte(value: int) -> Column:
    return F.unhex(F.lit(f"{value:02X}"))


def _big_endian(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * width, "0"))


def _head(major: int, n: Column) -> Column:
    """The CBOR head of a non-negative integer argument."""
    top = major << 5
    return (
        F.when(n < 24, F.unhex(F.lpad(F.hex(n + top), 2, "0")))
        .when(n < 1 << 8, F.concat(_byte(top | 24), _big_endian(n, 1)))
        .when(n < 1 << 16, F.concat(_byte(top | 25), _big_endian(n, 2)))
        .when(n < 1 << 32, F.concat(_byte(top | 26), _big_endian(n, 4)))
        .otherwise(F.concat(_byte(top | 27), _big_endian(n, 8)))
    )


def _text(said: str) -> bytes:
    raw = said.encode()
    n = len(raw)
    head = bytes([0x60 + n]) if n < 24 else bytes([0x78, n]) if n < 256 else bytes([0x79]) + n.to_bytes(2, "big")
    return head + raw


def _constant(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def cbor(value: Column, kind: T.DataType) -> Column:
    """A value as CBOR: integers, strings, binaries, booleans and nulls; other types are refused."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        wide = value.cast("long")
        out = F.when(wide >= 0, _head(0, wide)).otherwise(_head(1, -1 - wide))
    elif isinstance(kind, T.StringType):
        out = F.concat(_head(3, F.octet_length(value).cast("long")), F.encode(value, "UTF-8"))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(_head(2, F.octet_length(value).cast("long")), value)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, _byte(0xF5)).otherwise(_byte(0xF4))
    else:
        raise TypeError(f"no key encoding for {kind.simpleString()}")
    return F.when(value.isNull(), _byte(0xF6)).otherwise(out)


def _parts(table: str, key: dict[str, tuple[Column, T.DataType]]) -> tuple[bytes, list[Column]]:
    """The bytes of a key that are the same for all rows, from the start, and the expressions of the rest."""
    fixed, parts = b"\x9f" + _text(table), []
    for name in sorted(key):
        said = b"\x82" + _text(name)
        if parts:
            parts.append(_constant(said))
        else:
            fixed += said
        parts.append(cbor(*key[name]))
    return (fixed, [*parts, _byte(0xFF)]) if parts else (fixed + b"\xff", [])


def key_bytes(table: str, key: dict[str, tuple[Column, T.DataType]]) -> Column:
    fixed, parts = _parts(table, key)
    return F.concat(_constant(fixed), *parts)


def key_hash(table: str, key: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``fnv1`` of ``key_bytes``; what all rows have in common is hashed once, in the plan."""
    fixed, parts = _parts(table, key)
    return fnv1(F.concat(*parts) if parts else _constant(b""), fnv1_of(fixed))


def fnv1(data: Column, seed: int = SEED_HI << 32 | SEED_LO) -> Column:
    """struct(hi, lo): the two 32-bit limbs of the FNV-1 hash of a binary column, from ``seed`` on."""
    start = F.struct(F.lit(seed >> 32).cast("long").alias("hi"), F.lit(seed & LIMB).cast("long").alias("lo"))

    def hashed(digits: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            byte = F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
            low = s["lo"] * PRIME_LOW
            hi = (s["hi"] * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(s["lo"], 8)).bitwiseAND(LIMB)
            return F.struct(hi.alias("hi"), low.bitwiseAND(LIMB).bitwiseXOR(byte).alias("lo"))

        return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), start, step)).when(digits.isNotNull(), start)

    # A lambda's variable is evaluated once; an expression inside the inner lambda would be for each byte.
    return F.transform(F.array(F.hex(data)), hashed)[0]


def shard_of(hash_: Column, shards: int) -> Column:
    """1 .. shards: the unsigned hash modulo ``shards``, plus 1."""
    if not 0 < shards < 1 << 15:
        raise ValueError(f"no such number of shards: {shards}")
    return (((hash_["hi"] % shards) * ((1 << 32) % shards) + hash_["lo"] % shards) % shards + 1).cast("int")


def fnv1_of(data: bytes) -> int:
    """The same hash in Python, for what is known in the plan and for settings such as a node's id."""
    h = SEED_HI << 32 | SEED_LO
    for b in data:
        h = (h * ((1 << 40) + PRIME_LOW)) % (1 << 64) ^ b
    return h
