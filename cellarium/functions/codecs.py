"""Scalar functions: counters, integers, hashes, names, escapes. Built-in expressions where they exist, Arrow batches else."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the 64-bit MurmurHash2 variant for table keys.
MURMUR_MULTIPLIER, MURMUR_SHIFT, MURMUR_SEED = 0xC6A4A7935BD1E995, 47, 823
_MASK = (1 << 64) - 1

INT_FORMATS = {"int8": "<b", "uint8": "<B", "int16": "<h", "uint16": "<H", "int32": "<i", "uint32": "<I", "int64": "<q", "uint64": "<Q"}


def murmur64(key: bytes, seed: int = MURMUR_SEED) -> int:
    """MurmurHash64A of a key, as the published algorithm has it."""
    h = seed ^ (len(key) * MURMUR_MULTIPLIER & _MASK)
    words = len(key) // 8
    for (k,) in struct.iter_unpack("<Q", key[: 8 * words]):
        k = k * MURMUR_MULTIPLIER & _MASK
        k = (k ^ k >> MURMUR_SHIFT) * MURMUR_MULTIPLIER & _MASK
        h = (h ^ k) * MURMUR_MULTIPLIER & _MASK
    if tail := key[8 * words :]:
        h = (h ^ int.from_bytes(tail, "little")) * MURMUR_MULTIPLIER & _MASK
    h = (h ^ h >> MURMUR_SHIFT) * MURMUR_MULTIPLIER & _MASK
    return h ^ h >> MURMUR_SHIFT


def murmur_many(keys: list[bytes], seed: int = MURMUR_SEED) -> np.ndarray:
    """murmur64 of many keys at once: keys of one length are hashed together, word by word."""
    out = np.zeros(len(keys), np.uint64)
    m, r = np.uint64(MURMUR_MULTIPLIER), np.uint64(MURMUR_SHIFT)
    lengths = np.array([len(k) for k in keys], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join(keys[i].ljust(-(-int(n) // 8) * 8, b"\0") for i in at), "<u8").reshape(len(at), -1)
        h = np.full(len(at), seed ^ (int(n) * MURMUR_MULTIPLIER & _MASK), np.uint64)
        for j in range(n // 8):
            k = raw[:, j] * m
            h = (h ^ (k ^ (k >> r)) * m) * m
        if n % 8:
            h = (h ^ raw[:, n // 8]) * m
        h = (h ^ (h >> r)) * m
        out[at] = h ^ (h >> r)
    return out


@F.pandas_udf(StringType())
def hash_key(keys: pd.Series) -> pd.Series:
    """The stored form of a key of a hashed table: 16 hexadecimal digits, then the key. Null stays null."""
    known = keys.dropna()
    hashes = murmur_many([k.encode() for k in known])
    return pd.Series([f"{h:016x}{k}" for h, k in zip(hashes.tolist(), known)], known.index, dtype=object).reindex(keys.index)


def encode_counter(c: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))


def decode_counter(c: Column) -> Column:
    """Null unless there are eight bytes."""
    return F.when(F.length(c) == 8, F.conv(F.hex(c), 16, -10).cast("bigint"))


def encode_integer(kind: str, value: int) -> bytes:
    return struct.pack(INT_FORMATS[kind], value)


def decode_integer(kind: str, raw: bytes) -> int:
    return struct.unpack(INT_FORMATS[kind], raw[: struct.calcsize(INT_FORMATS[kind])])[0]


def _swapped(hexes: Column, width: int) -> Column:
    """2 * width hexadecimal digits with their bytes in reverse."""
    return F.concat(*(F.substring(hexes, 2 * i + 1, 2) for i in range(width - 1, -1, -1)))


def integer_bytes(kind: str, c: Column) -> Column:
    """encode_integer of a column of numbers that fit; null for null."""
    width = struct.calcsize(INT_FORMATS[kind])
    if kind == "uint64":  # numbers of over 63 bits are decimals
        high, low = F.floor(c.cast("decimal(20,0)") / F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint"), (c.cast("decimal(20,0)") % F.lit(1 << 32).cast("decimal(20,0)")).cast("bigint")
        digits = F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))
    else:
        digits = F.lpad(F.substring(F.lpad(F.hex(c.cast("bigint")), 16, "0"), 17 - 2 * width, 2 * width), 2 * width, "0")
    return F.unhex(_swapped(digits, width))


def integer_of(kind: str, c: Column) -> Column:
    """decode_integer of a binary column: a bigint, or a decimal(20,0) for uint64; null for fewer bytes."""
    width = struct.calcsize(INT_FORMATS[kind])
    plain = F.conv(_swapped(F.hex(c), width), 16, 10).cast("decimal(20,0)")
    if not kind.startswith("u"):
        whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")  # noqa: E731  some are over 63 bits
        plain = F.when(plain >= whole(1 << (8 * width - 1)), plain - whole(1 << (8 * width))).otherwise(plain)
    return F.when(F.octet_length(c) >= width, plain.cast("decimal(20,0)" if kind == "uint64" else "bigint"))


def encode_decimal(value: float) -> bytes:
    return struct.pack("<d", value)


def decode_decimal(raw: bytes) -> float:
    return struct.unpack("<d", raw[:8])[0]


def family_of(c: Column) -> Column:
    """What stands before the first colon of `family:qualifier`."""
    return F.split(c, ":", 2)[0]


def qualifier_of(c: Column) -> Column:
    return F.coalesce(F.get(F.split(c, ":", 2), F.lit(1)), F.lit(""))


def valid_name(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_.-]{0,511}$")


def escape(raw: bytes) -> str:
    """Visible ASCII as it is, the rest as \\xNN."""
    return "".join(chr(b) if 32 < b < 127 and b != 92 else f"\\x{b:02x}" for b in raw)


def unescape(text: str) -> bytes:
    """The bytes that escape() made text of; ValueError if it is none."""
    out, at = bytearray(), 0
    while at < len(text):
        if text[at] == "\\":
            if text[at + 1 : at + 2] != "x" or len(text) < at + 4:
                raise ValueError(f"bad escape at {at}")
            out.append(int(text[at + 2 : at + 4], 16))
            at += 4
        else:
            out += text[at].encode("latin-1")
            at += 1
    return bytes(out)


def byte_size(c: Column) -> Column:
    """Bytes for reading: 1023, 1.50K, 2.00M, ..."""
    out = F.format_string("%d", c.cast("bigint"))
    for i, unit in enumerate("KMGTP", 1):
        out = F.when(c >= 1024**i, F.concat(F.format_string("%.2f", c / F.lit(float(1024**i))), F.lit(unit))).otherwise(out)
    return out


_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def time_text(micros: Column) -> Column:
    """Microseconds since 1970 as a time to the second, whatever the session's zone is."""
    none = F.lit(0)
    return F.date_format(F.expr(_EPOCH) + F.make_dt_interval(none, none, none, (micros.cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)")), "yyyyMMdd-HH:mm:ss")


def time_of(text: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.to_timestamp_ntz(text, F.lit("yyyyMMdd-HH:mm:ss")))
