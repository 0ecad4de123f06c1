"""Tile pyramids: cells binned once at the deepest level and rolled up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.morton import BITS, with_key
from gridloom.operators.ids import by_hash

DEEPEST = BITS


def cap_for(tile_px: int = 512, thumb_px: int = 64) -> int:
    return (tile_px // thumb_px) ** 2


def ends() -> list[Column]:
    """Aggregates: left, top, right and bottom end of the cells' footprints."""
    return [F.min(F.col("x") - F.col("w") / 2), F.min(F.col("y") - F.col("h") / 2), F.max(F.col("x") + F.col("w") / 2), F.max(F.col("y") + F.col("h") / 2)]


def clamped(box) -> tuple[float, float, float, float]:
    """A box within the unit square; nothing is a point at 0."""
    return tuple(min(1.0, max(0.0, v or 0.0)) for v in box)  # type: ignore[return-value]


def bbox(cells: DataFrame) -> tuple[float, float, float, float]:
    """Left, top, right, bottom of the cells' footprints, within the unit square."""
    return clamped(cells.agg(*ends()).first())


def tile(c: Column, low: float, high: float, z: int) -> Column:
    """Tile number of a coordinate at level z; a flat axis has tile 0."""
    n = 1 << z
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), ((c - F.lit(low)) / F.lit(high - low) * n).cast("int"))) if high > low else F.lit(0)


def tiled(cells: DataFrame, box: tuple, z: int) -> DataFrame:
    return cells.withColumn("tx", tile(F.col("x"), box[0], box[2], z)).withColumn("ty", tile(F.col("y"), box[1], box[3], z))


#: The level whose tiles deal deeper ones out to tasks.
KNEE = 8


def spots(cells: DataFrame, box: tuple, deepest: int = DEEPEST) -> DataFrame:
    """The occupied tiles of the deepest level: tx, ty, n and the extents ax, bx, ay, by of their cells' centres."""
    return tiled(cells, box, deepest).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))


def _sums():
    return [F.sum("n").alias("n"), F.min("ax").alias("ax"), F.max("bx").alias("bx"), F.min("ay").alias("ay"), F.max("by").alias("by")]


def _up(column: str, by) -> Column:
    return F.expr(f"shiftright({column}, {by})")


def roll_up(fine: DataFrame, deepest: int = DEEPEST, n: int | None = None) -> DataFrame:
    """z, z_to, tx, ty (of level z_to), n and extents of the occupied tiles of all levels, from those of the deepest.

    The deepest tiles move once, to the task of their tile at level KNEE; the levels
    below that are made there.  In Morton order a tile shares its levels with the
    tiles before and after it and is alone on deeper ones: a row with z_to > z
    stands for a tile that holds one and the same deepest tile on all those levels.
    So only shared levels are added up, and there are no more rows than about twice
    the deepest tiles.  Levels down to KNEE are few tiles.  n: the cells, if the
    caller knows, so that a task's share does not grow with them.
    """
    knee = min(KNEE, deepest)
    size = deepest - knee
    columns = ["z", "z_to", "tx", "ty", "n", "ax", "bx", "ay", "by"]
    at = fine.withColumn("px", _up("tx", size)).withColumn("py", _up("ty", size))
    at = by_hash(at, "px", "py", n=n)
    top = at.groupBy("px", "py").agg(*_sums()).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(knee))))
    top = top.withColumn("tx", _up("px", f"{knee} - z")).withColumn("ty", _up("py", f"{knee} - z")).groupBy("z", "tx", "ty").agg(*_sums())
    top = top.withColumn("z_to", F.col("z")).select(columns)
    if not size:
        return top
    low = (1 << size) - 1
    k = with_key(at.withColumn("_x", F.col("tx").bitwiseAND(low)).withColumn("_y", F.col("ty").bitwiseAND(low)), "_k", "_x", "_y")
    order = Window.partitionBy("px", "py").orderBy("_k")

    def shared(other: Column) -> Column:
        """The deepest level at which this tile and the other are one."""
        return F.coalesce(F.lit(deepest) - F.ceil(F.length(F.bin(F.col("_k").bitwiseXOR(other))) / 2).cast("int"), F.lit(knee))

    k = k.withColumn("_s", F.greatest(F.lit(knee), shared(F.lag("_k").over(order)), shared(F.lead("_k").over(order))))
    # a level alone, the first one, stands for all below it: its row is its group, under the deepest number
    each = k.withColumn("z", F.explode(F.sequence(F.lit(knee + 1), F.least(F.col("_s") + 1, F.lit(deepest))))).withColumn("_lone", F.col("z") > F.col("_s"))
    each = each.withColumn("_tx", _up("tx", f"{deepest} - z")).withColumn("_ty", _up("ty", f"{deepest} - z")).groupBy("px", "py", "z", "_tx", "_ty")
    low_ = each.agg(*_sums(), F.max("_lone").alias("_lone"), F.max("tx").alias("tx"), F.max("ty").alias("ty"))
    own = lambda c: F.when(F.col("_lone"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    deep = low_.select("z", F.when(F.col("_lone"), deepest).otherwise(F.col("z")).alias("z_to"), own("tx"), own("ty"), "n", "ax", "bx", "ay", "by")
    return top.unionByName(deep)


def each_level(tiles: DataFrame) -> DataFrame:
    """z, tx, ty, n and extents: roll_up()'s tiles with a row for each level."""
    wide = tiles.withColumn("_l", F.explode(F.sequence("z", "z_to")))
    return wide.select(F.col("_l").alias("z"), _up("tx", "z_to - _l").alias("tx"), _up("ty", "z_to - _l").alias("ty"), "n", "ax", "bx", "ay", "by")


def levels(cells: DataFrame, box: tuple, deepest: int = DEEPEST) -> DataFrame:
    """z, tx, ty, n and extents of every level's occupied tiles: one scan at the deepest level, then a roll-up."""
    return each_level(roll_up(spots(cells, box, deepest), deepest))


def level_summary(tiles: DataFrame, cap: int, box: tuple = (0.0, 0.0, 1.0, 1.0), w: float = 0.0, h: float = 0.0, deepest: int = DEEPEST) -> DataFrame:
    """z, tiles, fullest, over (tiles above the cap), dropped, separable, packable of levels()' or roll_up()'s tiles.

    separable: some overfull tile's cells lie further apart than a tile of the deepest
    level, so deeper levels part them.  packable: some overfull tile's cells, each as
    large as the largest (w, h), have room side by side in the area that they span.
    """
    over = F.col("n") > cap
    wide, tall = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    apart = over & ((wide > F.lit((box[2] - box[0]) / (1 << deepest))) | (tall > F.lit((box[3] - box[1]) / (1 << deepest))))
    room = over & (F.col("n") * F.lit(w * h) <= (wide + F.lit(w)) * (tall + F.lit(h)))
    runs = tiles if "z_to" in tiles.columns else tiles.withColumn("z_to", F.col("z"))
    runs = runs.groupBy("z", "z_to").agg(F.count(F.lit(1)).alias("tiles"), F.max("n").alias("fullest"), F.count_if(over).alias("over"), F.sum(F.greatest(F.col("n") - cap, F.lit(0))).alias("dropped"), F.bool_or(apart).alias("separable"), F.bool_or(room).alias("packable"))
    each = runs.withColumn("z", F.explode(F.sequence("z", "z_to")))  # a few hundred rows
    return each.groupBy("z").agg(F.sum("tiles").alias("tiles"), F.max("fullest").alias("fullest"), F.sum("over").alias("over"), F.sum("dropped").alias("dropped"), F.bool_or("separable").alias("separable"), F.bool_or("packable").alias("packable"))


def size_ceiling(box: tuple, w: float, h: float, deepest: int = DEEPEST) -> int:
    """The deepest level whose tiles are no smaller than the largest cell."""
    fits = [math.floor(math.log2(span / cell)) for span, cell in ((box[2] - box[0], w), (box[3] - box[1], h)) if cell > 0 and span > 0]
    return max(0, min([deepest, *fits]))


def choose_z(summary: DataFrame, n: int, cap: int, box: tuple, w: float, h: float, deepest: int = DEEPEST) -> tuple[int, str]:
    """The deepest level to bake, and why it stops there.

    fits: no tile is overfull; coincident: what overfills a tile never parts;
    ceiling: deeper tiles are smaller than a cell and the cells lie in piles;
    budget: the next level has too many tiles; depth: the deepest level.
    summary: level_summary with the same cap, box, w and h.
    """
    if not n:
        return 0, "empty"
    ceiling, budget = size_ceiling(box, w, h), 16 * max(1, math.ceil(n / cap))
    after = F.lead("tiles").over(Window.orderBy("z"))  # one row a level
    why = (
        F.when(F.col("fullest") <= cap, "fits").when(~F.col("separable"), "coincident")
        .when((F.col("z") >= ceiling) & ~F.col("packable"), "ceiling").when(after > budget, "budget")
    )
    stop = summary.withColumn("why", F.when(F.col("z") < deepest, why)).filter("why is not null").orderBy("z").select("z", "why").first()
    return (stop["z"], stop["why"]) if stop else (deepest, "depth")


def coarser(fine: DataFrame, deepest: int, z: int) -> DataFrame:
    """The occupied tiles of level z, from those of a deeper one."""
    return fine.groupBy(_up("tx", deepest - z).alias("tx"), _up("ty", deepest - z).alias("ty")).agg(*_sums()) if z < deepest else fine


def settle(fine: DataFrame, n: int, cap: int, box: tuple, w: float, h: float) -> tuple[int, str]:
    """choose_z of a layout by its deepest tiles (spots()): looked for in the first 8 levels, then in 16, then in all, so that shallow pyramids never go deep."""
    for deepest in (8, 16, DEEPEST):
        z, why = choose_z(level_summary(roll_up(coarser(fine, DEEPEST, deepest), deepest, n), cap, box, w, h, deepest), n, cap, box, w, h, deepest)
        if why != "depth":
            break
    return z, why


def tile_spans(cells: DataFrame, box: tuple, z: int) -> DataFrame:
    """widest, tallest: how many tiles of level z the largest cell spans on each axis."""
    x, y = ((1 << z) / (b - a) if b > a else 0.0 for a, b in ((box[0], box[2]), (box[1], box[3])))
    return cells.agg((F.max("w") * F.lit(x)).alias("widest"), (F.max("h") * F.lit(y)).alias("tallest"))


def page_id(tx: Column, ty: Column, z: int) -> Column:
    """One number for a tile of a level up to 15: row by row."""
    if not 0 <= z <= 15:
        raise ValueError("levels of pages are 0 to 15")
    return ty.cast("long") * (1 << z) + tx


def covered(children: DataFrame, least: float = 0.45) -> DataFrame:
    """tx, ty, coverage, kept of the parents of tiles (tx, ty, alpha): the mean of four children, absent ones empty, and whether it is at least `least`."""
    parent = children.groupBy(F.shiftright("tx", 1).alias("tx"), F.shiftright("ty", 1).alias("ty")).agg((F.sum("alpha") / 4).alias("coverage"))
    return parent.withColumn("kept", F.col("coverage") >= least)


def fine(cells: DataFrame, box: tuple, z: int, cap: int) -> DataFrame:
    """id, tx, ty, slot, u, v of the `cap` lowest ids of each tile, with their places in the tile's small atlas."""
    per = math.isqrt(cap)
    rank = F.row_number().over(Window.partitionBy("tx", "ty").orderBy("id"))
    kept = tiled(cells, box, z).withColumn("rank", rank).filter(F.col("rank") <= cap).withColumn("slot", F.col("rank") - 1)  # a rank's bound cuts each sort early
    return kept.select("id", "tx", "ty", "slot", ((F.col("slot") % per) / per).alias("u"), (F.floor(F.col("slot") / per) / per).alias("v"))


def fine_tiles(cells: DataFrame, box: tuple, z: int, cap: int) -> DataFrame:
    """tx, ty, kept, dropped of each occupied tile: what fine() keeps there and what it leaves out."""
    n = tiled(cells, box, z).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    return n.select("tx", "ty", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"))


def neighbours(cells: DataFrame, box: tuple, z: int | None = None) -> DataFrame:
    """Pairs (id, other) of cells whose footprints overlap, found among the 3 x 3 tiles around each cell.

    Tiles must be no smaller than cells; without z they are as small as that allows, so
    that cells which meet in a tile and don't overlap are few.
    """
    if z is None:
        z = size_ceiling(box, *(v or 0.0 for v in cells.agg(F.max("w"), F.max("h")).first()))
    t = tiled(cells, box, z)
    near = t.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"), F.col("h").alias("oh"), (F.col("tx") + F.col("dx")).alias("tx"), (F.col("ty") + F.col("dy")).alias("ty"))
    j = t.join(near, ["tx", "ty"]).filter("id < other")
    return j.filter((F.abs(F.col("x") - F.col("ox")) < (F.col("w") + F.col("ow")) / 2) & (F.abs(F.col("y") - F.col("oy")) < (F.col("h") + F.col("oh")) / 2)).select("id", "other")
