"""Keyed hashes as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

_BLOCK = 64  # bytes of a SHA-256 block, a fixed value of the standard


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a string or binary column, in lower-case hex. Who may read the query's plan may read the key."""
    if not key:
        raise ValueError("an empty key hides nothing")
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)
