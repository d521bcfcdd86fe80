"""Byte-exact hashes, identifiers and codecs, on Arrow batches.

FNV-1a, jump consistent hash and the like are loops over bytes that no built-in function gives; they run as
vectorized Python functions, and only on the columns they need.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: FNV-1a offsets and primes, and the base-32 alphabet without i, l, o and u.
FNV32, FNV32_PRIME = 0x811C9DC5, 0x01000193
FNV64, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"
#: Linear congruential multiplier of jump consistent hashing.
JUMP = 2862933555777941757
#: Sort tags of key encoding: null, false, true, number, int64, string, bytes.
TAGS = {"null": 0x01, "false": 0x02, "true": 0x03, "number": 0x04, "int64": 0x05, "string": 0x06, "bytes": 0x07}


def fnv(data: bytes, start: int = FNV32, prime: int = FNV32_PRIME, bits: int = 32) -> int:
    h, mask = start, (1 << bits) - 1
    for b in data:
        h = (h ^ b) * prime & mask
    return h


def low_bytes(text: str) -> bytes:
    """The low byte of each UTF-16 unit."""
    return text.encode("utf-16-le", "surrogatepass")[::2]


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the low byte of each UTF-16 unit of a text; null stays null."""

    @F.arrow_udf("long")
    def h(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fnv(low_bytes(t)) for t in texts.to_pylist()], pa.int64())

    return h(text)


def jump_hash(key: int, buckets: int) -> int:
    """Jump consistent hashing (Lamping and Veach, 2014)."""
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * JUMP + 1) & (2**64 - 1)
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def shard_name(slot: int) -> str:
    return "default" if slot == 0 else f"s{slot}"


def encode_key_part(v: Any) -> bytes:
    """Order-preserving bytes of one scalar: type rank first, then the value."""
    if v is None:
        return bytes([TAGS["null"]])
    if isinstance(v, bool):
        return bytes([TAGS["true" if v else "false"]])
    if isinstance(v, float):
        if math.isnan(v):
            return bytes([TAGS["number"]]) + b"\xff" * 8
        (n,) = struct.unpack(">Q", struct.pack(">d", v + 0.0))
        return bytes([TAGS["number"]]) + (n ^ (2**64 - 1 if n >> 63 else 1 << 63)).to_bytes(8, "big")
    if isinstance(v, int):
        return bytes([TAGS["int64"]]) + (v + 2**63).to_bytes(8, "big")
    if isinstance(v, str | bytes | bytearray):
        raw, tag = (v.encode(), "string") if isinstance(v, str) else (bytes(v), "bytes")
        return bytes([TAGS[tag]]) + raw.replace(b"\0", b"\0\xff") + b"\0"
    raise TypeError("only scalars make an index key")


def order_key(v: Any) -> tuple:
    """A key that sorts any values in the total order: by type, then null, Booleans, numbers, integers, texts and bytes by
    value, arrays by their elements and objects by their fields in order of name, a shorter one before its extensions.
    """
    if isinstance(v, list | tuple):
        return (8, [order_key(x) for x in v])
    if isinstance(v, dict):
        return (9, [(k.encode(), order_key(v[k])) for k in sorted(v, key=str.encode)])
    part = encode_key_part(v)
    if isinstance(v, str | bytes | bytearray):
        return (part[0], v.encode() if isinstance(v, str) else bytes(v))
    return (part[0], part)


def encode_key(values: list) -> bytes:
    return b"".join(map(encode_key_part, values))


def successor(key: bytes) -> bytes:
    """The next key in byte order."""
    return key + b"\0"


def range_end(prefix: bytes) -> bytes:
    return prefix + b"\xff"


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key value: FNV-1a over its encoded bytes, then jump hashing. A null is a key like any other."""

    @F.arrow_udf("string")
    def shard(keys: pa.Array) -> pa.Array:
        return pa.array([shard_name(jump_hash(fnv(encode_key([v]), FNV64, FNV64_PRIME, 64), shards)) for v in keys.to_pylist()], pa.string())

    return shard(key)


def by_shard(df: DataFrame, key: str, shards: int, own: str | None = None) -> DataFrame:
    """`df` with its rows' `shard`, dealt by it; with `own` only that shard's rows, as a running shard may touch."""
    named = df.withColumn("shard", shard_of(F.col(key), shards))
    return named.repartition("shard") if own is None else named.where(F.col("shard") == own)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def fletcher16(data: bytes) -> int:
    low = high = 0
    for b in data:
        low = (low + b) % 255
        high = (high + low) % 255
    return high << 8 | low


def base32(data: bytes) -> str:
    bits, n, out = 0, 0, []
    for b in data:
        bits, n = bits << 8 | b, n + 8
        while n >= 5:
            n -= 5
            out.append(ALPHABET[bits >> n & 31])
    if n:
        out.append(ALPHABET[bits << 5 - n & 31])
    return "".join(out)


def unbase32(text: str) -> bytes:
    bits, n, out = 0, 0, bytearray()
    for c in text:
        if (v := ALPHABET.find(c)) < 0:
            raise ValueError("not an identifier")
        bits, n = bits << 5 | v, n + 5
        if n >= 8:
            n -= 8
            out.append(bits >> n & 255)
    return bytes(out)


def make_id(table: int, internal: bytes) -> str:
    """A document identifier: table number, 16 bytes, checksum, in base 32."""
    body = varint(table) + internal
    return base32(body + fletcher16(body).to_bytes(2, "big"))


def parse_id(text: str) -> tuple[int, bytes]:
    data = unbase32(text)
    table = shift = at = 0
    while True:
        b = data[at]
        table |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            break
    if len(data) != at + 18 or fletcher16(data[: at + 16]) != int.from_bytes(data[at + 16 :], "big"):
        raise ValueError("not an identifier")
    return table, data[at : at + 16]


def ids_of(table: int, internal: Column) -> Column:
    @F.arrow_udf("string")
    def made(parts: pa.Array) -> pa.Array:
        return pa.array([None if b is None else make_id(table, b) for b in parts.to_pylist()], pa.string())

    return made(internal)


def random_stream(seed: int):
    """The 32-bit generator that calls draw from, as floats below 1."""
    state = seed & 0xFFFFFFFF
    while True:
        state = state + 0x6D2B79F5 & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        yield ((t ^ t >> 14) & 0xFFFFFFFF) / 2**32


def stable_json(v: Any) -> str:
    """JSON with sorted keys, the input of configuration hashes."""
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def to_tagged(v: Any) -> Any:
    """Transport form: integers, bytes and non-finite floats as tagged objects; keys with a $ get one more."""
    b64 = lambda b: base64.b64encode(b).decode()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return {"$integer": b64(struct.pack("<q", v))}
    if isinstance(v, float):
        return v if math.isfinite(v) else {"$float": b64(struct.pack("<d", v))}
    if isinstance(v, bytes | bytearray):
        return {"$bytes": b64(bytes(v))}
    if isinstance(v, list | tuple):
        return [to_tagged(x) for x in v]
    return {("$" + k if k.startswith("$") else k): to_tagged(x) for k, x in v.items()}


def from_tagged(v: Any) -> Any:
    if isinstance(v, list):
        return [from_tagged(x) for x in v]
    if not isinstance(v, dict):
        return v
    if len(v) == 1:
        (k, x), *_ = v.items()
        if k == "$integer":
            return struct.unpack("<q", base64.b64decode(x))[0]
        if k == "$float":
            return struct.unpack("<d", base64.b64decode(x))[0]
        if k == "$bytes":
            return base64.b64decode(x)
    return {(k[1:] if k.startswith("$$") else k): from_tagged(x) for k, x in v.items()}
