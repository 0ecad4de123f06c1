"""Position tables, their comparison after a new bake, and keys that committed layouts keep."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def position_table(cells: DataFrame, n: int) -> DataFrame:
    """id, x, y, w, h as floats in order of id; an error unless the ids are 0 … n - 1, each once."""
    s = cells.agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.bit_xor(F.xxhash64("id")).alias("h")).first()
    ids = cells.sparkSession.range(n).agg(F.bit_xor(F.xxhash64("id")).alias("h")).first()
    if n and (s["rows"], s["n"], s["a"], s["b"], s["h"]) != (n, n, 0, n - 1, ids["h"]):
        raise ValueError(f"ids are not 0 … {n - 1}, each once: {s['n']} ids from {s['a']} to {s['b']}")
    return cells.select("id", *[F.col(c).cast("float").alias(c) for c in "xywh"]).orderBy("id")


def tolerance(low, high, size):
    """How far a repeated bake may differ: a part of the span, not below float32's step at that size and not above 1e-6."""
    return F.least(F.lit(1e-6), F.greatest((high - low) * 1e-4, size * (4 * 2.0**-24)))


def position_difference(baked: DataFrame, again: DataFrame) -> DataFrame:
    """n (ids in both), lost (ids in one only), dx, dy (greatest differences), tol_x, tol_y, same."""
    pair = baked.select("id", F.col("x").alias("x0"), F.col("y").alias("y0")).join(again.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")), "id", "full_outer")
    both = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    tol = [tolerance(F.min(c), F.max(c), F.max(F.abs(c))).alias(f"tol_{c[0]}") for c in ("x0", "y0")]
    r = pair.agg(F.count_if(both).alias("n"), F.count_if(~both).alias("lost"), F.max(F.abs(F.col("x0") - F.col("x1"))).alias("dx"), F.max(F.abs(F.col("y0") - F.col("y1"))).alias("dy"), *tol)
    return r.withColumn("same", (F.col("lost") == 0) & (F.coalesce("dx", F.lit(0.0)) <= F.coalesce("tol_x", F.lit(0.0))) & (F.coalesce("dy", F.lit(0.0)) <= F.coalesce("tol_y", F.lit(0.0))))


def rekeyed(items: DataFrame, committed: DataFrame, name: str = "filename") -> DataFrame:
    """items under the ids that committed (id, name) gave their names; items without one go."""
    return items.drop("id").join(committed.select("id", name), name)


def detail_refs(items: DataFrame, files: DataFrame, kind: str = "webp") -> DataFrame:
    """items (id) with detail_ref: the file <id>.<kind> where files (name) has it, else null."""
    wanted = F.concat(F.col("id").cast("string"), F.lit(f".{kind}"))
    return items.withColumn("_w", wanted).join(files.select(F.col("name").alias("detail_ref")).distinct(), F.col("_w") == F.col("detail_ref"), "left").drop("_w")


#: A stored box has so many decimals.
BOX_PLACES = 6


def refresh_verdicts(committed: DataFrame, again: DataFrame, baked: DataFrame, cells: DataFrame, version: str) -> DataFrame:
    """layout_id, verdict on whether what follows from a layout's geometry may be made anew for a stored one.

    committed: layout_id, version, n and the stored box x0, y0, x1, y1; again: layout_id
    and the box of the layout computed anew; baked, cells: layout_id, id, x, y, w, h as
    stored and as computed.  In this order: `newer`, the layout is of a later version
    (numbers between dots); `current`, of this one already; `lost`, it can't be computed; `moved`, the boxes
    differ at BOX_PLACES decimals; `unchecked`, it has no stored positions; `shrunk`, these
    are not n cells, or other ids; `diverged`, a place or size differs by more than
    tolerance() on its axis; else `same`.
    """
    parts = lambda v: F.transform(F.split(v, r"\."), lambda p: p.cast("int"))
    corners = ("x0", "y0", "x1", "y1")
    boxes = again.select("layout_id", *[F.col(c).alias(f"n{c}") for c in corners])
    pair = baked.select("layout_id", "id", *[F.col(c).cast("double").alias(f"b{c}") for c in "xywh"]).withColumn("in_b", F.lit(1)).join(cells.select("layout_id", "id", *"xywh").withColumn("in_c", F.lit(1)), ["layout_id", "id"], "full_outer")
    worst = pair.groupBy("layout_id").agg(F.count("in_b").alias("n_b"), F.count_if(F.col("in_b").isNull() | F.col("in_c").isNull()).alias("odd"), *[F.max(F.abs(F.col(c) - F.col(f"b{c}"))).alias(f"d{c}") for c in "xywh"])
    j = committed.join(boxes, "layout_id", "left").join(worst, "layout_id", "left")
    axis = {c: tolerance(F.col(f"n{a}0"), F.col(f"n{a}1"), F.greatest(F.abs(F.col(f"n{a}0")), F.abs(F.col(f"n{a}1")))) for c, a in zip("xywh", "xyxy", strict=True)}
    far = reduce(or_, [F.coalesce(F.col(f"d{c}") > axis[c], F.lit(False)) for c in "xywh"])
    moved = reduce(or_, [F.round(f"n{c}", BOX_PLACES) != F.col(c) for c in corners])
    verdict = (
        F.when(parts(F.col("version")) > parts(F.lit(version)), "newer").when(F.col("version") == version, "current").when(F.col("nx0").isNull(), "lost").when(moved, "moved")
        .when(F.coalesce("n_b", F.lit(0)) == 0, "unchecked").when((F.col("n_b") != F.col("n")) | (F.col("odd") > 0), "shrunk").when(far, "diverged").otherwise("same")
    )
    return j.select("layout_id", verdict.alias("verdict"))
