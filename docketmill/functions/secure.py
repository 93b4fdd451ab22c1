"""Sealing, signing and ids."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def sealed(data: Column, key: Column) -> Column:
    """AES-GCM of bytes under a 16, 24 or 32 byte key; each call seals differently."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def unsealed(data: Column, *keys: Column) -> Column:
    """What the first fitting key opens, else null: older keys are still read."""
    return F.coalesce(*(F.try_aes_decrypt(data, k, F.lit("GCM")) for k in keys))


def instance_id(message_id: Column, sender: Column) -> Column:
    """An id for a message's run that any replay gives again."""
    return F.concat(F.lit("run-"), F.substring(F.sha2(F.concat_ws("|", message_id, F.lower(sender)).cast("binary"), 256), 1, 40))


def ascii_header(text: Column) -> Column:
    """A text without line ends and with anything outside ASCII as a question mark."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"[^\x20-\x7E]", "?")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA-256 of a text by built-in functions."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def capability(user: Column, matter: Column, expires: Column, key: bytes) -> Column:
    """A signed leave for one user to read one matter until a time in seconds: expiry and signature."""
    seconds = expires.cast("string")
    return F.concat_ws(".", seconds, hmac_sha256(F.concat_ws("\n", user, matter, seconds), key))


def is_capable(token: Column, user: Column, matter: Column, now: Column, key: bytes) -> Column:
    """Whether a leave holds for this user and matter at a time in seconds."""
    expires = F.try_to_number(F.substring_index(token, ".", 1), F.lit("9999999999999"))
    return F.coalesce((capability(user, matter, F.substring_index(token, ".", 1), key) == token) & (now < expires), F.lit(False))
