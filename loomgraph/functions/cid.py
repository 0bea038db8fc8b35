"""Content identifiers: CIDv1, raw codec, sha2-256, lower-case base32, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: version 1, codec raw, hash sha2-256 of 32 bytes.
PREFIX = "01551220"
#: The digits that conv() writes in base 32, and base32's own.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "abcdefghijklmnopqrstuvwxyz234567"


def cid(content: Column) -> Column:
    """CID of a string or binary column; null stays null.

    36 bytes are 57.6 base-32 digits. Ten hex digits (40 bits) make exactly
    eight base-32 digits, so the padded hex is cut in eight groups.
    """
    return cid_of(F.sha2(content.cast("binary"), 256))


def cid_of(digest: Column) -> Column:
    """CID of a SHA-256 in hex: in a lambda, where an expression is computed each time that it is named."""
    hex_ = F.rpad(F.concat(F.lit(PREFIX), digest), 80, "0")
    group = lambda i: F.translate(F.lpad(F.conv(F.substring(hex_, i * 10 + 1, 10), 16, 32), 8, "0"), CONV_DIGITS, BASE32_DIGITS)
    return F.concat(F.lit("b"), F.substring(F.concat(*[group(i) for i in range(8)]), 1, 58))


def cid_to_uri(c: Column) -> Column:
    return F.concat(F.lit("ipfs://"), c)


def uri_to_cid(u: Column) -> Column:
    """What follows ipfs://; anything else is returned unchanged."""
    return F.regexp_replace(u, "^ipfs://", "")
