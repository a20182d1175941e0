"""Column encryption, key re-wrapping and envelope keys.

AES-GCM through Spark's ``aes_encrypt`` / ``aes_decrypt``.  Keys never appear
in plan text: a literal key would be printed by ``explain`` and logged, so
the key travels as a column of a one-row DataFrame that is broadcast (one row,
a proven size bound) and joined on a constant tag.  Keys are 16, 24 or 32
bytes and are supplied by the caller.

Envelope keys: a key ring is a table (key_id, wrapped_key) of data keys, each
encrypted under one wrap key.  Rows name their data key by ``key_id``.  Rotation
re-wraps the ring under a new wrap key and never touches the data.
"""

from __future__ import annotations

import secrets
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.plans.strategy import bounded_broadcast
from runledger.session import cut_lineage

_KEY_SCHEMA = T.StructType([T.StructField("_key_tag", T.IntegerType())])


def _with_keys(df: DataFrame, keys: Mapping[str, bytes]) -> DataFrame:
    spark: SparkSession = df.sparkSession
    for name, key in keys.items():
        if len(key) not in (16, 24, 32):
            raise ValueError(f"{name}: AES keys are 16, 24 or 32 bytes")
    schema = T.StructType(list(_KEY_SCHEMA.fields) + [T.StructField(n, T.BinaryType()) for n in keys])
    key_row = spark.createDataFrame([(1, *[bytearray(k) for k in keys.values()])], schema)
    # The tag must not be a literal: the optimizer would move ``tag = 1`` into
    # the key side and plan a join without keys (nested loop).  A value the
    # optimizer cannot fold keeps it a broadcast hash join on the tag.
    tag = F.spark_partition_id() * 0 + 1
    return (
        df.withColumn("_key_tag", tag)
        .join(F.broadcast(key_row), "_key_tag", "inner")
        .drop("_key_tag")
    )


def _one_line(ciphertext: Column) -> Column:
    """Base64 without the line breaks Spark puts into long output."""
    return F.translate(F.base64(ciphertext), "\r\n", "")


def encrypt_columns(df: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """Text columns -> base64 of AES-GCM ciphertext (random IV per value)."""
    k = _with_keys(df, {"_k": key})
    return k.select(*[
        _one_line(F.aes_encrypt(F.col(c).cast("binary"), F.col("_k"), F.lit("GCM"))).alias(c)
        if c in columns else F.col(c)
        for c in df.columns
    ])


def decrypt_columns(df: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """base64 ciphertext -> text; a wrong key or damaged value -> NULL."""
    k = _with_keys(df, {"_k": key})
    return k.select(*[
        F.try_aes_decrypt(F.unbase64(F.col(c)), F.col("_k"), F.lit("GCM")).cast("string").alias(c)
        if c in columns else F.col(c)
        for c in df.columns
    ])


def rewrap_columns(df: DataFrame, columns: Sequence[str], old_key: bytes, new_key: bytes) -> DataFrame:
    """Re-encrypt values under a new key in one pass (decrypt with the
    old key, encrypt with the new), without the plain text leaving the task.  A value
    that the old key does not open becomes NULL, as in ``decrypt_columns``."""
    k = _with_keys(df, {"_old": old_key, "_new": new_key})
    return k.select(*[
        _one_line(F.aes_encrypt(
            F.try_aes_decrypt(F.unbase64(F.col(c)), F.col("_old"), F.lit("GCM")),
            F.col("_new"), F.lit("GCM"))).alias(c)
        if c in columns else F.col(c)
        for c in df.columns
    ])


# ------------------------------------------------------------------ envelope keys
def create_key_ring(key_ids: DataFrame, wrap_key: bytes, id_col: str = "key_id") -> DataFrame:
    """A fresh 256-bit data key for each distinct key id, wrapped under ``wrap_key``.

    The data key is a digest of a ciphertext with a random nonce under a one-time
    random key; it is drawn and wrapped in one expression, so it stands in no plan and
    in no file.  The ring is checkpointed before it is returned: recomputing a lost
    partition would draw other keys, and data encrypted under the first ones could
    not be opened any more.
    """
    ids = key_ids.select(F.col(id_col).alias("key_id")).where(F.col(id_col).isNotNull()).distinct()
    k = _with_keys(ids, {"_seed": secrets.token_bytes(32), "_wrap": wrap_key})
    drawn = F.unhex(F.sha2(F.aes_encrypt(F.col("key_id").cast("string").cast("binary"), "_seed", F.lit("GCM")), 256))
    return cut_lineage(k.select("key_id", _one_line(F.aes_encrypt(drawn, "_wrap", F.lit("GCM"))).alias("wrapped_key")))


def _opened_key(wrap: str = "_wrap") -> Column:
    return F.try_aes_decrypt(F.unbase64("wrapped_key"), F.col(wrap), F.lit("GCM"))


def _with_data_keys(df: DataFrame, ring: DataFrame, wrap_key: bytes, id_col: str) -> DataFrame:
    """``df`` with its rows' wrapped data keys and the wrap key.  The data keys are
    opened in the task that uses them; broadcasts and shuffles carry wrapped ones."""
    keys = bounded_broadcast(ring.select(F.col("key_id").alias(id_col), "wrapped_key"))
    return _with_keys(df.join(keys, id_col, "left"), {"_wrap": wrap_key})


def encrypt_with_ring(df: DataFrame, columns: Sequence[str], ring: DataFrame, wrap_key: bytes,
                      id_col: str = "key_id") -> DataFrame:
    """E1 under each row's own data key.  A value whose key is not in the ring, or is not
    opened by ``wrap_key``, fails the job: writing NULL would lose the value."""
    k = _with_data_keys(df, ring, wrap_key, id_col)
    key = F.coalesce(_opened_key(), F.raise_error(F.lit("no data key for a value to encrypt")).cast("binary"))
    return k.select(*[
        F.when(F.col(c).isNotNull(), _one_line(F.aes_encrypt(F.col(c).cast("binary"), key, F.lit("GCM")))).alias(c)
        if c in columns else F.col(c) for c in df.columns])


def decrypt_with_ring(df: DataFrame, columns: Sequence[str], ring: DataFrame, wrap_key: bytes,
                      id_col: str = "key_id") -> DataFrame:
    """E1 under each row's own data key; an absent or unopened key, or a damaged value -> NULL."""
    k = _with_data_keys(df, ring, wrap_key, id_col)
    return k.select(*[
        F.try_aes_decrypt(F.unbase64(F.col(c)), _opened_key(), F.lit("GCM")).cast("string").alias(c)
        if c in columns else F.col(c) for c in df.columns])


def rotate_key_ring(ring: DataFrame, old_wrap: bytes, new_wrap: bytes) -> DataFrame:
    """The same data keys under a new wrap key.  Work and writes are those of the ring,
    whatever the size of the data, whose ciphertexts stay as they are.  A key that
    ``old_wrap`` does not open fails the rotation: its data would be lost."""
    k = _with_keys(ring, {"_wrap": old_wrap, "_new": new_wrap})
    data = F.coalesce(_opened_key(), F.raise_error(F.lit("a data key is not opened by the old wrap key")).cast("binary"))
    return k.select(*[_one_line(F.aes_encrypt(data, "_new", F.lit("GCM"))).alias(c) if c == "wrapped_key" else F.col(c)
                      for c in ring.columns])
