"""Deterministic hashing: buckets of SHA-256, salted orders, resampling indexes, canonical fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklens.functions.numbers import col

_TWO64 = "18446744073709551616"


def sha_bucket(text: Column, buckets: int) -> Column:
    """floor(top 64 bits of SHA-256 * buckets / 2**64): equal shares of the hash range."""
    top = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.floor(top * F.lit(buckets).cast("decimal(10,0)") / F.lit(_TWO64).cast("decimal(20,0)")).cast("int")


def split_of(source: str | Column, group: str | Column) -> Column:
    """train, val or test, 8 : 1 : 1, by source (trimmed, lower case) and group."""
    b = sha_bucket(F.concat(F.lower(F.trim(col(source).cast("string"))), F.lit("\x1f"), col(group).cast("string")), 10)
    return F.when(b < 8, "train").when(b == 8, "val").otherwise("test")


def salted_split(salt: str, key: str | Column, train_percent: int = 90) -> Column:
    return F.when(sha_bucket(F.concat(F.lit(salt), col(key).cast("string")), 100) < train_percent, "train").otherwise("val")


def salted_order(salt: str, key: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), col(key).cast("string")), 256)


def draw(n: str | Column, *parts: str | int | Column) -> Column:
    """An index in [0, n) that depends on the parts alone; the same in any engine with MD5."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), col(n))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns' text in the order of their names; null is its own value."""
    return F.sha2(F.concat_ws("\x1e", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) for c in sorted(columns)]), 256)
