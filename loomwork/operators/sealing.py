"""Sealed containers: magic, salt, nonce and AES-256-GCM over a framed payload; the key by PBKDF2."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.binary import u_be
from loomwork.functions.names import container_name
from loomwork.shared import free_name

# Fixed values of the container format.
MAGIC, ITERATIONS, META_CAP, INPUT_CAP = bytes.fromhex("534e534531"), 600_000, 65_536, 512 << 20


@lru_cache(maxsize=4096)
def _key(passphrase: str, salt: bytes, iterations: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, iterations, 32)


def derived_key(passphrase: Column, salt: Column, iterations: int = ITERATIONS) -> Column:
    """The key of a passphrase and a salt, null if either is. A worker derives a pair once and remembers 4,096."""

    @F.pandas_udf("binary")
    def run(p: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _key(a, bytes(b), iterations) for a, b in zip(p, s)])

    return run(passphrase, salt)


def seal(df: DataFrame, data: Column, name: Column, kind: Column, passphrase: Column, salt: Column, nonce: Column, iterations: int = ITERATIONS, cap: int = INPUT_CAP) -> DataFrame:
    """df with ``container``, or null and ``error_code`` 'big' if data is over ``cap`` bytes. salt has 16 bytes, nonce 12."""
    key = free_name("key", *df.columns, "container", "error_code")
    meta = F.to_json(F.struct(F.substring(name, 1, 1024).alias("n"), F.substring(kind, 1, 256).alias("t"), F.octet_length(data).alias("s"))).cast("binary")
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(meta).cast("long")), 8, "0")), meta, data)
    fits = F.octet_length(data) <= cap
    keyed = df.withColumn(key, F.when(fits, derived_key(passphrase, salt, iterations)))
    return keyed.withColumns({"container": F.when(fits, sealed_frame(framed, F.col(key), salt, nonce)), "error_code": F.when(~fits, "big")}).drop(key)


def sealed_frame(framed: Column, key: Column, salt: Column, nonce: Column) -> Column:
    return F.concat(F.lit(MAGIC), salt, F.aes_encrypt(framed, key, F.lit("GCM"), F.lit("DEFAULT"), nonce))


def unseal(df: DataFrame, container: Column, passphrase: Column, iterations: int = ITERATIONS, cap: int = INPUT_CAP) -> DataFrame:
    """df with name, type, bytes and error_code: magic, big or pass; a meta part that is no JSON is let through."""
    taken = [*df.columns, "name", "type", "bytes", "error_code"]
    key, plain = free_name("key", *taken), free_name("plain", *taken)
    shaped = (F.octet_length(container) >= 33 + 16 + 4) & (F.substring(container, 1, 5) == F.lit(MAGIC))
    big = F.octet_length(container) > cap + 33 + 4 + META_CAP + 16
    salt = F.when(shaped & ~big, F.substring(container, 6, 16))
    keyed = df.withColumn(key, derived_key(passphrase, salt, iterations))
    opened = keyed.withColumn(plain, F.when(shaped & ~big, F.try_aes_decrypt(F.substring(container, F.lit(22), F.octet_length(container)), F.col(key), F.lit("GCM"))))
    size = F.octet_length(plain)
    n = F.when(size >= 4, u_be(F.col(plain), 0, 4))
    good = n.isNotNull() & (n <= META_CAP) & (n + 4 <= size)
    code = F.when(~F.coalesce(shaped, F.lit(False)), "magic").when(big, "big").when(F.col(plain).isNull(), "pass").when(~good, "magic")
    meta = F.try_parse_json(F.decode(F.substring(F.col(plain), F.lit(5), n.cast("int")), "UTF-8"))
    field = lambda p, other: F.coalesce(F.nullif(F.try_variant_get(meta, p, "string"), F.lit("")), F.lit(other))
    return opened.withColumns({
        "error_code": code, "name": F.when(code.isNull(), container_name(field("$.n", "decrypted.bin"))), "type": F.when(code.isNull(), field("$.t", "application/octet-stream")),
        "bytes": F.when(code.isNull(), F.substring(F.col(plain), (n + 5).cast("int"), size)),
    }).drop(plain, key)
