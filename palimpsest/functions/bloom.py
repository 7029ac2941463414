"""Bloom filters as relations: sizing, bits of a key, and the serialised form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_bits(capacity: Column, rate: float) -> Column:
    """Bits for ``capacity`` keys at a false-positive ``rate``; 1 for no keys."""
    bits = F.ceil(-capacity * math.log(rate) / (math.log(2) ** 2))
    return F.when(capacity <= 0, 1).otherwise(F.greatest(F.lit(1), bits)).cast("bigint")


def hash_count(capacity: Column, bits: Column) -> Column:
    """Hash functions for ``bits``, rounded half to even; 1 for no keys."""
    return F.when(capacity <= 0, 1).otherwise(F.greatest(F.lit(1), F.bround(bits / capacity * math.log(2)))).cast("bigint")


#: Hexadecimal digits of a SHA-256 digest that are converted at a time: as many as are sure to fit a long.
_DIGITS = 15


def bit_of(key: Column, round_no: Column, bits: Column) -> Column:
    """SHA-256 of the UTF-8 key and the round as a big-endian 32-bit number, modulo ``bits``, which must be below 2^31.

    The digest is folded a few words at a time: remainders are below 2^31, so that no product leaves the range of a long.
    """
    digest = F.sha2(F.concat(F.encode(key, "UTF-8"), F.unhex(F.lpad(F.hex(round_no.cast("bigint")), 8, "0"))), 256)
    first = 64 % _DIGITS
    shift = F.lit(16**_DIGITS) % bits

    def word(start: int, digits: int) -> Column:
        return F.conv(F.substring(digest, start + 1, digits), 16, 10).cast("bigint") % bits

    bit = word(0, first)
    for start in range(first, 64, _DIGITS):
        bit = ((bit * shift) % bits + word(start, _DIGITS)) % bits
    return bit
