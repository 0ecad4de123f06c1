"""What a viewer asks of a layout: ranges, picks, hotspots, samples, ticks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import half_up
from gridloom.operators.pyramid import tiled
from gridloom.operators.ranks import ranked


def overlaps(view: tuple[float, float, float, float]):
    """Footprints that share area with the view; touching is not enough."""
    x, y, w, h = (F.col(c) for c in "xywh")
    return (x + w / 2 > view[0]) & (x - w / 2 < view[2]) & (y + h / 2 > view[1]) & (y - h / 2 < view[3])


def in_view(cells: DataFrame, view: tuple) -> DataFrame:
    return cells.filter(overlaps(view)).agg(F.count(F.lit(1)).alias("n"))


def range_scan(cells: DataFrame, view: tuple, cap: int) -> DataFrame:
    """id of the cells in view in order, none where more than cap are: a top-k of cap + 1, then the test."""
    top = cells.filter(overlaps(view)).orderBy("id").limit(cap + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())  # at most cap + 1 rows
    return top.withColumn("n", n).filter(F.col("n") <= cap).select("id")


def pick(cells: DataFrame, px: float, py: float) -> DataFrame:
    """The cell under a point: nearest centre, ties to the higher id."""
    dx, dy = F.col("x") - px, F.col("y") - py
    hit = cells.filter((F.abs(dx) <= F.col("w") / 2) & (F.abs(dy) <= F.col("h") / 2))
    return hit.withColumn("d2", dx * dx + dy * dy).orderBy("d2", F.desc("id")).limit(1).select("id", "d2")


def hotspots(cells: DataFrame, box: tuple, z: int, cap: int) -> DataFrame:
    """tx, ty, n, dropped, x, y of overfull tiles; the place is that of the lowest id."""
    t = tiled(cells, box, z).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.min_by("x", "id").alias("x"), F.min_by("y", "id").alias("y"))
    return t.filter(F.col("n") > cap).withColumn("dropped", F.col("n") - cap)


def marker_bins(cells: DataFrame, matched, g: int) -> DataFrame:
    """gx, gy, matched, n and bounds of cells on a g x g grid over the centres' extent."""
    e = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def at(c, low, high):
        return F.least(F.lit(g - 1), F.floor((F.col(c) - F.lit(low)) / F.lit(high - low) * g)).cast("int") if high is not None and high > low else F.lit(0)

    b = cells.withColumn("gx", at("x", e[0], e[1])).withColumn("gy", at("y", e[2], e[3])).withColumn("matched", matched)
    x, y, w, h = (F.col(c) for c in "xywh")
    return b.groupBy("gx", "gy", "matched").agg(F.count(F.lit(1)).alias("n"), F.min(x - w / 2).alias("x0"), F.min(y - h / 2).alias("y0"), F.max(x + w / 2).alias("x1"), F.max(y + h / 2).alias("y1"))


def coincident(cells: DataFrame, size: float) -> DataFrame:
    """The lowest id of each group of cells that fall on one spot of the screen."""
    return cells.groupBy(half_up(F.col("x") / size).alias("bx"), half_up(F.col("y") / size).alias("by")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def extremes(cells: DataFrame, k: int) -> DataFrame:
    """Ids of the k leftmost and k rightmost cells."""
    left, right = cells.orderBy("x", "id").limit(k), cells.orderBy(F.desc("x"), "id").limit(k)
    return left.select("id").union(right.select("id")).distinct()


def upper_median(cells: DataFrame, column: str) -> DataFrame:
    """The value at place floor(n / 2) of the sorted column; no row without values."""
    value = ranked(cells, {column: 0.5}, upper=True)[column][0]
    out = cells.select(F.col(column).alias("median")).limit(0)
    return out if value is None else cells.sparkSession.createDataFrame([(value,)], out.schema)


def time_fit(points: DataFrame, x: str, t: str) -> DataFrame:
    """Least squares t = a x + b; null where x does not vary."""
    return points.agg(F.regr_slope(t, x).alias("a"), F.regr_intercept(t, x).alias("b"))


def visible_tiles(spark, box: tuple, view: tuple, z: int) -> DataFrame:
    """tx, ty of the tiles in view with a margin of one, row by row."""
    n = 1 << z

    def span(low, high, a, b):
        f = lambda v: math.floor((v - low) / (high - low) * n)
        return max(0, f(a) - 1), min(n - 1, f(b) + 1)

    (x0, x1), (y0, y1) = span(box[0], box[2], view[0], view[2]), span(box[1], box[3], view[1], view[3])
    if x1 < x0 or y1 < y0:
        return spark.createDataFrame([], "tx int, ty int")
    return spark.range(1).select(F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("ty")).select(F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("tx"), "ty")


def focal_order(tiles: DataFrame, box: tuple, z: int, fx: float, fy: float) -> DataFrame:
    """Tiles by distance of their centres from a point; ties row by row."""
    n = 1 << z
    dx = F.lit(box[0]) + (F.col("tx") + 0.5) / n * (box[2] - box[0]) - fx
    dy = F.lit(box[1]) + (F.col("ty") + 0.5) / n * (box[3] - box[1]) - fy
    return tiles.withColumn("d2", dx * dx + dy * dy).orderBy("d2", "ty", "tx")


def level_for(edge: float, zoom: float, tile_px: int, dpr: float, baked: list[int]) -> int:
    """The baked level nearest above what the screen resolves."""
    want = math.ceil(math.log2(max(min(max(dpr, 1), 2) * edge / (zoom * tile_px), 1)))
    return next((z for z in sorted(baked) if z >= want), max(baked))


def selection_digest(items: DataFrame, categories: list[str], time: str) -> DataFrame:
    """field, value, n of each category column and, for the time column, its first and last value."""
    stacked = items.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in categories])).alias("s")).select("s.*")
    counts = stacked.filter("value is not null and value != ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    ends = items.agg(F.min(time).cast("string").alias("a"), F.max(time).cast("string").alias("b"), F.count(time).alias("n"))
    return counts.unionByName(ends.select(F.lit(time).alias("field"), F.concat_ws(" .. ", "a", "b").alias("value"), "n"))


def declutter(chips: DataFrame, gap: float, most: int) -> DataFrame:
    """The chips (id, n, x, y) that stay: by count, each at least `gap` from all before, at most `most`.

    A round takes the 16 * most fullest chips that are far enough from all taken ones
    and folds them; rounds go on until `most` are taken or no chip is left.
    """
    spark, kind = chips.sparkSession, "array<struct<m:bigint,id:bigint,n:bigint,x:double,y:double>>"
    taken: list = []
    while len(taken) < most:
        far = chips
        for t in taken:  # at most `most` tests
            far = far.filter((F.col("x") - F.lit(t["x"])) ** 2 + (F.col("y") - F.lit(t["y"])) ** 2 >= F.lit(gap * gap))
        one = far.orderBy(F.desc("n"), "id").limit(16 * most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "n", "x", "y"))).alias("c"))
        fold = f"aggregate(c, cast(array() as {kind}), (a, p) -> if(size(a) < {most - len(taken)} and forall(a, q -> pow(q.x - p.x, 2) + pow(q.y - p.y, 2) >= {gap * gap}D), concat(a, array(p)), a))"
        more = one.select(F.expr(fold).alias("c")).first()["c"]
        if not more:
            break
        taken += more
    return spark.createDataFrame([(t["id"], t["n"], t["x"], t["y"]) for t in taken], "id long, n long, x double, y double")


def declutter_boxes(labels: DataFrame, most: int) -> DataFrame:
    """The labels (id, n, x0, y0, x1, y1) that stay: by count, none over one before it, at most `most`; in rounds as declutter()."""
    kind = "array<struct<m:bigint,id:bigint,n:bigint,x0:double,y0:double,x1:double,y1:double>>"
    columns = ["id", "n", "x0", "y0", "x1", "y1"]
    taken: list = []
    while len(taken) < most:
        free = labels
        for t in taken:  # at most `most` tests
            free = free.filter((F.col("x0") >= F.lit(t["x1"])) | (F.col("x1") <= F.lit(t["x0"])) | (F.col("y0") >= F.lit(t["y1"])) | (F.col("y1") <= F.lit(t["y0"])))
        one = free.orderBy(F.desc("n"), "id").limit(16 * most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), *columns))).alias("c"))
        fold = f"aggregate(c, cast(array() as {kind}), (a, p) -> if(size(a) < {most - len(taken)} and forall(a, q -> p.x0 >= q.x1 or p.x1 <= q.x0 or p.y0 >= q.y1 or p.y1 <= q.y0), concat(a, array(p)), a))"
        more = one.select(F.expr(fold).alias("c")).first()["c"]
        if not more:
            break
        taken += more
    return labels.sparkSession.createDataFrame([tuple(t[c] for c in columns) for t in taken], "id long, n long, x0 double, y0 double, x1 double, y1 double")


def members_box(cells: DataFrame, members: DataFrame) -> DataFrame:
    """value, n and the box x0, y0, x1, y1 around the footprints of each value's members (value, id)."""
    x, y, w, h = (F.col(c) for c in "xywh")
    return cells.join(members, "id").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(x - w / 2).alias("x0"), F.min(y - h / 2).alias("y0"), F.max(x + w / 2).alias("x1"), F.max(y + h / 2).alias("y1"))


def evictions(resident: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
    """The tiles (tile, used) to drop, longest unused first, until budget remain; kept ones stay."""
    over = max(0, resident.count() - budget)
    return resident.join(kept, "tile", "left_anti").orderBy("used", "tile").limit(over)
