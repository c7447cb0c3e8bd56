"""Opaque keys: shown once, stored as SHA-256, without expiry, revocable."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import functions as F

from halyard.errors import UNAUTHORIZED, EngineError
from halyard.semantic.store import Store

PREFIX = "hk_"


def digest(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def create_key(store: Store, user: str, role: str = "reader") -> str:
    key = PREFIX + secrets.token_urlsafe(32)
    row = store.spark.createDataFrame([(digest(key), user, role)], "key_hash string, user_id string, role string")
    row = row.select("*", F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    store.write({"credentials": store.read("credentials").unionByName(row)})
    return key


def revoke_key(store: Store, key_or_hash: str) -> int:
    """Revoke a key given itself or its hash; number of keys that were valid."""
    h = digest(key_or_hash) if key_or_hash.startswith(PREFIX) else key_or_hash
    old = store.read("credentials")
    mine = (F.col("key_hash") == h) & F.col("revoked_at").isNull()
    n = old.where(mine).count()
    if n:
        store.write({"credentials": old.withColumn("revoked_at", F.when(mine, F.current_timestamp()).otherwise(F.col("revoked_at")))})
    return n


def user_of(store: Store, key: str) -> str:
    """The user of a valid key, or unauthorized."""
    rows = store.read("credentials").where((F.col("key_hash") == digest(key)) & F.col("revoked_at").isNull()).limit(1).collect()
    if not rows:
        raise EngineError(UNAUTHORIZED, "the key isn't valid", {})
    return rows[0].user_id
