"""Bulk column encryption with AES-256-GCM (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def raw_key(key_base64: str) -> Column:
    """A base64 key as 32 bytes."""
    import base64

    raw = base64.b64decode(key_base64)
    if len(raw) != 32:
        raise ValueError("the key must be 32 bytes, base64 encoded")
    return F.unhex(F.lit(raw.hex()))


def _bytes(text: Column) -> Column:
    """Decoded base64, or null where the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def encrypted(value: Column, key: Column) -> Column:
    """base64(iv(12) ‖ ciphertext ‖ tag(16)) with a fresh iv per row."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT")))


def decrypted(value: Column, key: Column) -> Column:
    """Plain text, or null where text or key is wrong."""
    return F.try_aes_decrypt(_bytes(value), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def encrypt_column(df: DataFrame, column: str, key: Column, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, encrypted(F.col(column), key))


def decrypt_column(df: DataFrame, column: str, key: Column, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, decrypted(F.col(column), key))


def quarantine(df: DataFrame, cipher: str, plain: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that have a cipher text but could not be read)."""
    bad = F.col(cipher).isNotNull() & F.col(plain).isNull()
    return df.filter(~bad), df.filter(bad)


def rekey(df: DataFrame, column: str, old: Column, new: Column) -> DataFrame:
    """Cipher text under another key in one projection; unreadable rows become null."""
    return df.withColumn(column, encrypted(decrypted(F.col(column), old), new))


def _int_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def import_text_envelope(value: Column, key: Column) -> Column:
    """Plain text of base64(JSON{iv, authTag, data}) with base64 members."""
    j = F.from_json(_bytes(value).cast("string"), "iv string, authTag string, data string")
    body = F.concat(_bytes(j["iv"]), _bytes(j["data"]), _bytes(j["authTag"]))
    return F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def import_array_envelope(value: Column, key: Column) -> Column:
    """Plain text of base64(JSON{iv: [bytes], data: [bytes with tag]})."""
    j = F.from_json(_bytes(value).cast("string"), "iv array<int>, data array<int>")
    body = F.concat(_int_bytes(j["iv"]), _int_bytes(j["data"]))
    return F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def import_envelopes(df: DataFrame, column: str, text_key: Column, array_key: Column, out: str = "plain") -> DataFrame:
    """Reads both envelope forms; the form is seen from the JSON text."""
    is_text = F.contains(_bytes(F.col(column)).cast("string"), F.lit('"authTag"'))
    plain = F.when(is_text, import_text_envelope(F.col(column), text_key)).otherwise(
        import_array_envelope(F.col(column), array_key)
    )
    return df.withColumn(out, plain)
