"""Identifier expressions: canonical UUID text, name-based UUIDs (RFC 4122 v5) and md5 ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value that must match the metered service: namespace of estimated-event ids.
ESTIMATE_NAMESPACE = "67f9a35c-567c-4a30-b51d-2fc64328bd55"

CANONICAL = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _hyphenate(hex32: Column) -> Column:
    return F.concat_ws(
        "-",
        F.substring(hex32, 1, 8),
        F.substring(hex32, 9, 4),
        F.substring(hex32, 13, 4),
        F.substring(hex32, 17, 4),
        F.substring(hex32, 21, 12),
    )


def md5_uuid(text: Column) -> Column:
    """Deterministic id from text: md5 hex cut 8-4-4-4-12 (not a versioned UUID)."""
    return _hyphenate(F.md5(text))


def packed_uuid(text: Column, name: str) -> list[Column]:
    """Two columns for ``unpacked_uuid(df, name)``: the 16 bytes of canonical UUID text, and any other
    text as it stands. Half as long as the text where many ids are shuffled."""
    canonical = text.rlike(CANONICAL.replace("$", r"\z"))  # not before a last line break
    packed = F.unhex(F.replace(text, F.lit("-"), F.lit("")))
    return [F.when(canonical, packed).alias(f"{name}_packed"), F.when(~canonical, text).alias(f"{name}_text")]


def unpacked_uuid(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the text, or NULL, that ``packed_uuid(text, name)`` was made of. The digits have a
    column of their own: within the text they would be made anew for each of its pieces."""
    packed, digits, other = (f"{name}_{x}" for x in ("packed", "digits", "text"))
    df = df.withColumn(digits, F.lower(F.hex(packed)))
    text = F.when(F.col(digits).isNotNull(), _hyphenate(F.col(digits))).otherwise(F.col(other))
    return df.withColumn(name, text).drop(packed, digits, other)


def uuid5_name(name: Column, namespace: str = ESTIMATE_NAMESPACE) -> Column:
    """The bytes that a version-5 UUID is the digest of: namespace || ``name`` in UTF-8. What they
    begin with may be built once and ASCII text appended to it later."""
    return F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8"))


def uuid5_of(name: Column) -> Column:
    """Version-5 UUID, as lower-case text, of the bytes of ``uuid5_name``.

    sha1, first 16 bytes, version nibble 5 and the variant bits 10xx in the high nibble of
    byte 8. The digest's hex digits are cut as bytes, where a piece is a copy (in text it is a walk
    over the characters), and assembled in one flat ``concat``, so the digest is read a few
    times, not re-derived through nested expressions."""
    text = F.sha1(name)
    d = text.cast("binary")
    code = F.ascii(F.substring(text, 17, 1))
    low_bits = (code + F.shiftright(code, 6)).bitwiseAND(3)  # of a hex digit, by its ASCII code
    hyphen = F.lit(b"-")
    return F.concat(
        F.substring(d, 1, 8),
        hyphen,
        F.substring(d, 9, 4),
        F.lit(b"-5"),
        F.substring(d, 14, 3),
        hyphen,
        F.substring(F.lit(b"89ab"), low_bits + 1, F.lit(1)),
        F.substring(d, 18, 3),
        hyphen,
        F.substring(d, 21, 12),
    ).cast("string")


def uuid5_col(name: Column, namespace: str = ESTIMATE_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of ``name`` (UTF-8) in ``namespace``, as lower-case text."""
    return uuid5_of(uuid5_name(name, namespace))


def canonical_uuid(text: Column) -> Column:
    """Canonical lower-case UUID text, or NULL when ``text`` is not a UUID.

    Accepts what Python's ``uuid.UUID(text)`` accepts: ``urn:`` and ``uuid:`` removed,
    braces stripped from both ends, hyphens removed, any case; exactly 32 hex digits must
    remain. Surrounding blanks are not accepted. Text that is canonical already stays as it is;
    only other text is rewritten."""
    h = F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    h = F.lower(F.replace(F.regexp_replace(h, r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit("")))
    return F.when(text.rlike(CANONICAL), text).otherwise(F.when(h.rlike("^[0-9a-f]{32}$"), _hyphenate(h)))
