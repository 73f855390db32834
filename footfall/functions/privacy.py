"""Pseudonymous visitor keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.network import truncate_ip
from footfall.functions.times import let

CLIENT_ID = r"^[a-f0-9]{32}$"
_BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def with_pads(keys: DataFrame, key: str) -> DataFrame:
    """Adds the two padded key blocks of the keyed hash; done once per key, not per hashed row."""
    raw = F.encode(F.col(key), "UTF-8")
    raw = F.when(F.octet_length(raw) > _BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)

    def pad(padded: Column, byte: int) -> Column:
        word = int(f"{byte:02x}" * 4, 16)
        words = F.transform(
            F.sequence(F.lit(1), F.lit(_BLOCK * 2 - 7), F.lit(8)),
            lambda i: F.lpad(
                F.hex(F.conv(F.substring(padded, i, F.lit(8)), 16, 10).cast("bigint").bitwiseXOR(F.lit(word))), 8, "0"
            ),
        )
        return F.unhex(F.array_join(words, ""))

    block = F.rpad(F.hex(raw), _BLOCK * 2, "0")
    return keys.withColumn("_ipad", let(block, lambda p: pad(p, 0x36))).withColumn("_opad", let(block, lambda p: pad(p, 0x5C)))


def hmac_sha256(ipad: Column, opad: Column, message: Column) -> Column:
    """Keyed hash as lower-case hex, from the built-in digest."""
    inner = F.unhex(F.sha2(F.concat(ipad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(opad, inner), 256)


def visitor_key(hits: DataFrame, salts: DataFrame, site_salt: str, site: str) -> DataFrame:
    """Adds visitor_key (32 hex). Salts are (day, salt), one row per UTC day; ``enhanced`` marks consented hits.

    The salt table has a row per day, so the join side stays small whatever the traffic.
    """
    per_day = with_pads(salts.select(F.col("day").alias("_day"), F.col("salt").alias("_salt")), "_salt").drop("_salt")
    joined = hits.withColumn("_day", F.to_date("received_at")).join(F.broadcast(per_day), "_day", "left")
    message = F.concat_ws("|", truncate_ip("ip"), F.coalesce("user_agent", F.lit("")), F.lit(site))
    ipad, opad = (F.lit(p) for p in _pads(site_salt.encode()))
    key = F.when(
        F.col("enhanced"), hmac_sha256(ipad, opad, F.concat(F.lit("vid|"), F.col("vid")))
    ).otherwise(hmac_sha256(F.col("_ipad"), F.col("_opad"), message))
    return joined.withColumn("visitor_key", F.left(key, F.lit(32))).drop("_day", "_ipad", "_opad")
