"""Layouts stored once in Morton order, and read by key ranges.

A cell's key interleaves its tile numbers at the deepest level, so a tile of any
level is one range of keys, and a view is a few.  Files and row groups hold
neighbouring keys; a range in a filter skips the others by their statistics.
Beside the cells stand their occupied deepest tiles, from which pyramids roll up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.morton import key_of, with_key
from gridloom.operators.ids import by_range
from gridloom.operators.pyramid import DEEPEST, clamped, ends, spots, tiled
from gridloom.sources.tables import shared_dir

#: Key ranges of one view at most; more would be joined into coarser ones.
RANGES = 24
#: Bytes of a row group: small, as a view reads few.
GROUP_BYTES = 1 << 20


def keyed(cells: DataFrame, box: tuple, z: int = DEEPEST, name: str = "key") -> DataFrame:
    """cells with the Morton key of their tile at level z."""
    return with_key(tiled(cells, box, z), name).drop("tx", "ty")


@dataclass(frozen=True)
class Baked:
    """A stored layout: where it is, how many cells it has, the box of their footprints and their largest width and height."""

    path: str
    n: int
    box: tuple[float, float, float, float]
    w: float
    h: float

    def cells(self, spark: SparkSession) -> DataFrame:
        """key and the columns of all cells."""
        return spark.read.parquet(f"{self.path}/cells")

    def spots(self, spark: SparkSession) -> DataFrame:
        """The occupied tiles of the deepest level: tx, ty, n and the extents of their cells."""
        return spark.read.parquet(f"{self.path}/spots")

    def near(self, spark: SparkSession, view: tuple[float, float, float, float]) -> DataFrame:
        """The cells whose footprints may touch a view, and others of the same key ranges: to be tested by the caller."""
        reach = view[0] - self.w / 2, view[1] - self.h / 2, view[2] + self.w / 2, view[3] + self.h / 2
        return self.cells(spark).filter(_within(ranges(self.box, reach)))


def _within(found: list[tuple[int, int]]) -> Column:
    test = F.lit(False)
    for low, high in found:
        test = test | F.col("key").between(low, high)
    return test


def ranges(box: tuple, view: tuple, most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` key ranges (both ends within) that hold all cells whose centres lie in the view.

    Quarters that lie across the view's edge are split, level by level, while the ranges stay few.
    """

    def span(i: int) -> tuple[int, int]:
        low, high = box[i], box[i + 2]
        if not high > low:
            return 0, 0
        n = 1 << DEEPEST
        return tuple(min(n - 1, max(0, math.floor((v - low) / (high - low) * n) + d)) for v, d in ((view[i], -1), (view[i + 2], 1)))  # a tile of slack each way for rounding

    if view[0] > view[2] or view[1] > view[3]:
        return []
    (x0, x1), (y0, y1) = span(0), span(1)
    whole: list[tuple[int, int, int]] = []
    edge = [(0, 0, 0)]
    for z in range(DEEPEST + 1):
        size = DEEPEST - z
        inside = [(z, tx, ty) for _, tx, ty in edge if tx << size >= x0 and (tx + 1 << size) - 1 <= x1 and ty << size >= y0 and (ty + 1 << size) - 1 <= y1]
        across = [t for t in edge if (z, t[1], t[2]) not in inside]
        halves = [(z + 1, 2 * tx + i, 2 * ty + j) for _, tx, ty in across for j in (0, 1) for i in (0, 1)]
        halves = [(q, tx, ty) for q, tx, ty in halves if tx << size - 1 <= x1 and (tx + 1 << size - 1) - 1 >= x0 and ty << size - 1 <= y1 and (ty + 1 << size - 1) - 1 >= y0] if size else []
        if not halves or len(_joined(whole + inside + halves)) > most:
            whole += [(z, tx, ty) for _, tx, ty in edge]
            break
        whole, edge = whole + inside, halves
    return _joined(whole)


def _joined(tiles: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key ranges of tiles (z, tx, ty), neighbouring ones as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((key_of(tx, ty) << 2 * (DEEPEST - z), (key_of(tx, ty) + 1 << 2 * (DEEPEST - z)) - 1) for z, tx, ty in tiles):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def bake(cells: DataFrame, path: str | None = None) -> Baked:
    """Stores a layout (id, x, y, w, h and any other columns) in the given folder, or a new one of the shared folder.

    The cells are dealt out by ranges of their keys, so no task holds more than its
    share, and sorted by key and id.  An empty layout is stored as such.
    """
    spark = cells.sparkSession
    path = path or shared_dir(spark)
    about = cells.agg(*ends(), F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max("h").alias("h")).first()
    box, (n, w, h) = clamped(about[:4]), about[4:]
    ordered = by_range(keyed(cells, box), "key", n=n).sortWithinPartitions("key", "id")
    ordered.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/cells")
    out = Baked(path, n, box, w or 0.0, h or 0.0)
    spots(out.cells(spark), box).write.parquet(f"{path}/spots")
    spark.createDataFrame([(n, *map(float, box), out.w, out.h)], "n long, x0 double, y0 double, x1 double, y1 double, w double, h double").coalesce(1).write.parquet(f"{path}/about")  # last: a folder without it is not whole
    return out


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a layout is stored there, to its end."""
    about = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    return about.getFileSystem(spark._jsc.hadoopConfiguration()).exists(about)


def opened(spark: SparkSession, path: str) -> Baked:
    """A layout that bake() has stored."""
    r = spark.read.parquet(f"{path}/about").first()
    return Baked(path, r["n"], (r["x0"], r["y0"], r["x1"], r["y1"]), r["w"], r["h"])


def in_tile(baked: Baked, spark: SparkSession, z: int, tx: int, ty: int) -> DataFrame:
    """The cells of one tile: one range of keys."""
    size = 2 * (DEEPEST - z)
    return baked.cells(spark).filter(F.col("key").between(key_of(tx, ty) << size, (key_of(tx, ty) + 1 << size) - 1))
