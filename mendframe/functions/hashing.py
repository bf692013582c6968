"""Hash-ranked randomness.

A draw depends only on (seed, stream, key), never on partitioning, so results are the
same on any cluster and after any retry, and a SQL engine with md5 can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_BITS = 52
BUCKET_BITS = 16


def hash_hex(seed: int, stream: str, *keys: Column | str) -> Column:
    """md5 of ``seed|stream|key...`` as 32 hex digits; uniform over distinct keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{stream}"), *[p.cast("string") for p in parts]))


def hex_to_unit(digest: Column) -> Column:
    """First 52 bits of a digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(2.0**UNIT_BITS)


def unit(seed: int, stream: str, *keys: Column | str) -> Column:
    """Uniform draw in [0, 1) per key."""
    return hex_to_unit(hash_hex(seed, stream, *keys))


def hash_bucket(digest: Column) -> Column:
    """First four hex digits of a digest: 65,536 buckets that sort like the digest."""
    return F.substring(digest, 1, BUCKET_BITS // 4)


def hash_slot(digest: Column) -> Column:
    """The bucket of a digest as a number: 0..65535."""
    return F.conv(hash_bucket(digest), 16, 10).cast("int")


def pick_index(draw: Column, size: Column | int) -> Column:
    """Map a unit draw to 0..size-1."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.least(F.floor(draw * size), size - 1).cast("bigint")


def normal(seed: int, stream: str, *keys: Column | str) -> Column:
    """Standard normal draw per key (Box-Muller on two unit draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - unit(seed, stream + "/r", *keys)))
    angle = F.lit(6.283185307179586) * unit(seed, stream + "/a", *keys)
    return radius * F.cos(angle)
