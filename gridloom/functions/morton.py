"""Morton keys: the bits of two tile numbers in turn, so that a tile of any level is one range of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The deepest level of tiles: bits of a tile number.
BITS = 24
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def spread(df: DataFrame, column: str) -> DataFrame:
    """df with the bits of a number below 2**32 moved apart, a zero before each."""
    df = df.withColumn(column, F.col(column).cast("long"))
    for step, mask in _MASKS:
        df = df.withColumn(column, F.col(column).bitwiseOR(F.shiftleft(column, step)).bitwiseAND(F.lit(mask)))
    return df


def with_key(tiles: DataFrame, name: str = "key", x: str = "tx", y: str = "ty") -> DataFrame:
    """tiles with the key of their numbers."""
    t = spread(spread(tiles.withColumn("_mx", F.col(x)).withColumn("_my", F.col(y)), "_mx"), "_my")
    return t.withColumn(name, F.col("_mx").bitwiseOR(F.shiftleft("_my", 1))).drop("_mx", "_my")


def key_of(tx: int, ty: int) -> int:
    """The key of one tile."""
    return sum(((tx >> i & 1) << 2 * i) | ((ty >> i & 1) << 2 * i + 1) for i in range(BITS))
