"""Keys: names to ids, comparison, padding, digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def transform(name: Column, namespace: str | None = None, bits: int = 512, digits: int | None = None) -> Column:
    """The hex id of a name: the digest of ``namespace NUL name``, cut or zero-padded on the right to ``digits``."""
    whole = name if namespace is None else F.concat(F.lit(namespace), F.chr(F.lit(0)), name)
    own = F.sha2(whole.cast("binary"), bits)
    return own if digits is None else F.rpad(own, digits, "0")


def parse_id(hex_text: Column, digits: int = 128) -> Column:
    """A short hex id is left-aligned: zeros fill up on the right."""
    return F.rpad(F.lower(hex_text), digits, "0")


def parse_bound(hex_text: Column, digits: int = 128) -> Column:
    """A scan bound is a number: zeros fill up on the left; "-1" is the largest id."""
    return F.when(hex_text == "-1", F.lit("f" * digits)).otherwise(F.lpad(F.lower(hex_text), digits, "0"))


def time_before(sec_a: Column, nsec_a: Column, sec_b: Column, nsec_b: Column) -> Column:
    return F.struct(sec_a, nsec_a) < F.struct(sec_b, nsec_b)


def leading(hex_id: Column, digits: int = 15) -> Column:
    """The leading digits of an id as a number (15 fit into a long)."""
    return F.conv(F.substring(hex_id, 1, digits), 16, 10).cast("long")


def _little_endian(hex_bytes: Column) -> Column:
    """16 hex digits, the lowest byte first, as a number of 64 bits (from 2^63 on: negative)."""
    return F.conv(F.concat(*[F.substring(hex_bytes, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")


def shard(hex_id: Column, shards: int) -> Column:
    """Cache shard of an id: its first 8 bytes XOR its last 8, as an unsigned number, modulo the number of shards."""
    mixed = _little_endian(F.substring(hex_id, 1, 16)).bitwiseXOR(_little_endian(F.substring(hex_id, -16, 16)))
    return F.pmod(F.shiftrightunsigned(mixed, 1) % shards * 2 + mixed.bitwiseAND(1), F.lit(shards))


def keyed_digest(data: Column, secret: bytes, bits: int = 512) -> Column:
    """HMAC of a binary column with SHA-2, as hex: a digest of the padded secret and the digest of the other padded secret and the data."""
    block = 128 if bits > 256 else 64
    key = (secret if len(secret) <= block else hashlib.new(f"sha{bits}", secret).digest()).ljust(block, b"\0")
    padded = lambda mask: F.lit(bytes(x ^ mask for x in key))
    return F.sha2(F.concat(padded(0x5C), F.unhex(F.sha2(F.concat(padded(0x36), data.cast("binary")), bits))), bits)


def ring_percent(width: Column, digits: int = 15) -> Column:
    """A difference of leading digits as a percentage of the whole ring."""
    return width * 100.0 / F.lit(float(16**digits - 1))
