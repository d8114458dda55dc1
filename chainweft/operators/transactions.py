"""Normalised transactions from deliveries.

Defined cases: null and empty addresses are null, null or empty input counts as ``0x``; a row without recipient is a
creation. Amounts that don't fit decimal(38,0) are null, not an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.functions.identity import address, chain, ether, event_type, hex_text, input_bytes
from chainweft.functions.scalars import flag, gwei, high_value
from chainweft.operators.dedup import first_messages

#: Columns of a normalised transaction.
NORMALISED = ["seq", "tx_hash", "block_number", "block_timestamp", "sender", "recipient", "value_wei", "value_eth", "log_value_eth", "is_high_value", "gas", "gas_price_gwei", "selector", "input_length", "is_creation", "is_call", "chain"]


def normalise(rows: DataFrame) -> DataFrame:
    """Canonical spellings and derived fields for every row."""
    value = ether(F.col("value_wei"))
    return rows.select(
        "seq",
        F.concat(F.lit("0x"), hex_text(F.col("tx_hash"))).alias("tx_hash"),
        "block_number",
        "block_timestamp",
        address(F.col("from_addr")).alias("sender"),
        address(F.col("to_addr")).alias("recipient"),
        "value_wei",
        value.alias("value_eth"),
        F.log1p(value).alias("log_value_eth"),
        flag(high_value(value)).alias("is_high_value"),
        "gas",
        gwei(F.col("gas_price")).alias("gas_price_gwei"),
        event_type(F.col("input_data")).alias("selector"),
        input_bytes(F.col("input_data")).alias("input_length"),
        (address(F.col("to_addr")).isNull()).alias("is_creation"),
        (address(F.col("to_addr")).isNotNull() & (F.coalesce(F.length("input_data"), F.lit(0)) > 2)).alias("is_call"),
        chain(F.col("chain_name")).alias("chain"),
    )


def distinct_transactions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns of ``normalise`` for one delivery of each hash, the one with the smallest ``seq``."""
    slim = normalise(rows)
    keep = [c for c in NORMALISED if c in {*columns, "seq", "tx_hash"}]
    return first_messages(slim.select(keep), "tx_hash", "seq", keep).select(columns)
