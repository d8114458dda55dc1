"""Canonical forms of addresses, hashes, chain names and event types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a method selector with its prefix.
SELECTOR_CHARS = 10
#: Event type of a transaction whose input holds no selector.
PLAIN_TRANSFER = "0x"


def hex_text(c: Column) -> Column:
    """Lower-case hexadecimal text without ``0x``; null stays null."""
    low = F.lower(F.trim(c))
    return F.when(low.startswith("0x"), F.substring(low, 3, 2**31 - 1)).otherwise(low)


def address(c: Column) -> Column:
    """Lower-case address with ``0x``; null and empty give null."""
    text = hex_text(c)
    return F.when(F.length(text) > 0, F.concat(F.lit("0x"), text))


def fixed_id(c: Column, width: int = 32) -> Column:
    """The identifier as ``width`` bytes, or null where it isn't that many bytes of hexadecimal text."""
    text = hex_text(c)
    return F.when(F.length(text) == 2 * width, F.unhex(text))


def chain(c: Column) -> Column:
    """Chain name without regard to case and outer blanks."""
    return F.lower(F.trim(c))


def event_type(c: Column) -> Column:
    """The method selector in ``input_data``, or ``0x`` where the input is shorter than one or null."""
    return F.when(F.length(c) >= SELECTOR_CHARS, F.lower(F.substring(c, 1, SELECTOR_CHARS))).otherwise(F.lit(PLAIN_TRANSFER))


def input_bytes(c: Column) -> Column:
    """Whole bytes of hexadecimal input after its prefix; null and empty count as ``0x``."""
    return F.greatest(F.lit(0), F.floor((F.coalesce(F.length(c), F.lit(2)) - 2) / 2)).cast("long")


def ether(wei: Column) -> Column:
    """Wei as ether in double precision."""
    return wei.cast("double") / F.lit(1e18)
