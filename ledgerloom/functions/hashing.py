"""HMAC-SHA256 composed from the built-in SHA-2."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_message


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hexadecimal HMAC-SHA256 of a string or binary column."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def content_hmac(key: bytes, body: Column, sender: Column, scheme: str = "v1") -> Column:
    """Identity of a message: its normalised body and sender, not its time of delivery."""
    message = F.concat_ws("\0", F.lit(scheme), F.coalesce(body, F.lit("")), F.lower(F.coalesce(normalize_message(sender), F.lit(""))))
    return hmac_sha256(key, message)
