"""Bit maps of hashed keys: which rows certainly have no partner in another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in a map: 4,096 rows of 4 KB, 16 MB in all, whatever the tables' size.
BITS = 1 << 27
_BUCKET, _MAP, _PLACE = "__bucket", "__map", "__place"


def _place(columns: Sequence[str], bits: int) -> Column:
    """A bit's number, from 1 on. Spark hashes 0.0 and -0.0, which are equal, alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1


def key_map(table: DataFrame, columns: Sequence[str], bits: int = BITS) -> DataFrame:
    """The keys of `table` as a map of `bits` bits, one row per 32,768 of them that has any set.

    Each task sends a partial map, so at most `bits` / 8 bytes, however often a key occurs.
    """
    place = _place(columns, bits)
    return table.groupBy(F.bitmap_bucket_number(place).alias(_BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(_MAP)
    )


def with_possible_partner(
    rows: DataFrame, columns: Sequence[str], keys: DataFrame, name: str, bits: int = BITS
) -> DataFrame:
    """`rows` with the boolean column `name`: false where the map `keys` proves that no row of
    its table has the same values in `columns`, true where one may have.

    A true value may be a collision of hashes, a false one never is. The map is broadcast;
    its size is bounded by `bits`, not by the tables.
    """
    # Bit p of a map is bit p % 8, the lowest first, of byte p / 8.
    at = F.bitmap_bit_position(F.col(_PLACE))
    byte = F.hex(F.substr(F.col(_MAP), (F.floor(at / 8) + 1).cast("int"), F.lit(1)))
    is_set = F.getbit(F.conv(byte, 16, 10).cast("long"), (at % 8).cast("int")) == 1
    placed = rows.withColumn(_PLACE, _place(columns, bits)).withColumn(_BUCKET, F.bitmap_bucket_number(F.col(_PLACE)))
    return (
        placed.join(F.broadcast(keys), _BUCKET, "left")
        .withColumn(name, F.coalesce(is_set, F.lit(False)))
        .drop(_BUCKET, _MAP, _PLACE)
    )
