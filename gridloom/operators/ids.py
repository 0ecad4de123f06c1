"""Dense ids, first-wins joins and integrity checks."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.tables import stored


#: Rows that one task should sort, where a caller knows how many there are.
SORTED = 500_000


def _parts(df: DataFrame, n: int | None) -> list[int]:
    """The number of tasks that keeps the share of each near SORTED rows of n; none where the session's is enough."""
    parts = math.ceil((n or 0) / SORTED)
    return [parts] if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def by_range(df: DataFrame, *order: str, n: int | None = None) -> DataFrame:
    """df dealt out by ranges of `order`; n: its rows, if the caller knows, for as many tasks as they need."""
    return df.repartitionByRange(*_parts(df, n), *order)


def by_hash(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df dealt out by keys; n: as in by_range()."""
    return df.repartition(*_parts(df, n), *keys)


def dense_ids(df: DataFrame, *order: str, name: str = "id", n: int | None = None) -> DataFrame:
    """df with ids 0 … n-1 by rank in `order`; n: its rows, if the caller knows.

    Range-partitioned and sorted in parallel; only one row a partition, its count,
    meets in one place, so no task holds the whole table.  Those few rows go to the
    stored table's tasks, so reading it moves none of its rows.
    """
    ranged = by_range(df, *order, n=n).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_dense_part", F.spark_partition_id()).withColumn("_dense_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_dense_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_dense_part").agg(F.count(F.lit(1)).alias("_dense_n")).withColumn("_dense_base", F.coalesce(F.sum("_dense_n").over(before), F.lit(0))).drop("_dense_n")
    return ranged.join(F.broadcast(base), "_dense_part").withColumn(name, F.col("_dense_base") + F.col("_dense_at")).drop("_dense_part", "_dense_at", "_dense_base")


#: Rows of a group that one task may sort.
GROUP = 200_000


def ranks_within(df: DataFrame, group: str, *order: str, largest: int | None = None, name: str = "rank") -> DataFrame:
    """df with each row's place 0 … n-1 in its group, by `order`; ties in no fixed order. No group may be null.

    The table is dealt out by ranges of (group, order), so a group of any size is
    sorted by many tasks; a row's place is its place in the task's part of the group,
    plus the group's rows in the parts before, of which there is one number a part and
    group.  Where the caller knows that no group holds more than GROUP rows (largest),
    a window does the same without storing the table.
    """
    if largest is not None and largest <= GROUP:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = stored(ranged.withColumn("_w_part", F.spark_partition_id()).withColumn("_w_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    parts = ranged.groupBy("_w_part", group).agg(F.count(F.lit(1)).alias("_w_n"), F.min("_w_at").alias("_w_first"))
    before = Window.partitionBy(group).orderBy("_w_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("_w_base", F.coalesce(F.sum("_w_n").over(before), F.lit(0)) - F.col("_w_first")).drop("_w_n", "_w_first")
    return ranged.join(base, ["_w_part", group]).withColumn(name, F.col("_w_at") + F.col("_w_base")).select(*df.columns, name)


def join_first(base: DataFrame, metadata: DataFrame, key: str, order: str) -> DataFrame:
    """base with the first (by order) metadata row of its key, if any; matched says whether there is one. Null keys never match."""
    columns = [c for c in metadata.columns if c != key]
    first = metadata.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_m"))
    joined = base.join(first, key, "left")
    return joined.select(*base.columns, *[F.col(f"_m.{c}").alias(c) for c in columns], F.col("_m").isNotNull().alias("matched"))


def matched_count(base: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """n, matched: rows of base, and those whose key metadata has."""
    known = metadata.select(key).distinct().withColumn("_known", F.lit(True))
    return base.join(known, key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("_known").alias("matched"))


def survivors(base: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows of base whose key is in kept, renumbered densely in the old order."""
    return dense_ids(base.join(kept.select(key).distinct(), key, "left_semi").withColumnRenamed("id", "old_id"), "old_id")


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, n, examples (at most 5, sorted) of the keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    both = a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("side").orderBy(key))).filter("r <= 5").groupBy("side").agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("examples"))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n")).join(top, "side")


#: The most ids of one look-up.
IDS = 250


def by_ids(df: DataFrame, key: str, asked: str) -> DataFrame:
    """Rows of the ids in a comma-separated list, blanks ignored; an error for anything but whole numbers, for none, or for over IDS."""
    parts = [p.strip() for p in asked.split(",") if p.strip()]
    if not parts or len(parts) > IDS or not all(re.fullmatch(r"-?\d+", p) for p in parts):
        raise ValueError(f"ids are 1 to {IDS} whole numbers")
    return df.filter(F.col(key).isin(sorted(set(map(int, parts)))))
