"""Keyed and keyless digests built from the JVM's sha2."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, inside whole-stage codegen."""
    inner, outer = pads(key)
    digest = F.sha2(F.concat(F.lit(inner), c.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def lane_of(c: Column, lanes: Column) -> Column:
    """A stable lane number in [0, lanes): the first 32 bits of the id's md5."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint") % lanes


def content_id(*cols: Column) -> Column:
    """An id that a retry computes again: a hash of the identifying columns."""
    return F.sha2(F.concat_ws("|", *cols), 256)
