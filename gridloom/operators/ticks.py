"""Time axes: the line between time and place, and ticks on the bins that a layout was made with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of ticks on an axis without bins, in years.
YEAR_STEPS = (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 5000, 10000)
#: Units of the next larger calendar unit; a unit's months or seconds.
CYCLE = {"second": 60, "minute": 60, "hour": 24, "month": 12}
MONTHS, SECONDS = {"year": 12, "month": 1}, {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_LABEL = {"year": "y", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:mm", "minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss"}


def place_of(seconds: Column, domain: tuple[float, float], reach: tuple[float, float]) -> Column:
    """The place of a time on the axis from domain (seconds) to reach."""
    return F.lit(reach[0]) + (seconds - F.lit(domain[0])) * F.lit((reach[1] - reach[0]) / (domain[1] - domain[0]))


def time_at(place: Column, domain: tuple[float, float], reach: tuple[float, float]) -> Column:
    """The time (seconds) of a place: place_of's inverse."""
    return F.lit(domain[0]) + (place - F.lit(reach[0])) * F.lit((domain[1] - domain[0]) / (reach[1] - reach[0]))


def uniform(kind: str, step: int) -> bool:
    """Whether all bins of a calendar step are alike: smaller steps start anew with their next unit, and days only go one by one."""
    return step >= 1 and (kind in MONTHS or (kind in CYCLE and CYCLE[kind] % step == 0) or (kind, step) == ("day", 1))


def _ordinal(seconds: Column, kind: str) -> Column:
    """A moment in whole months since year 0, or in seconds since 1970, as the unit counts."""
    t = F.timestamp_seconds(seconds)
    return F.year(t) * 12 + F.month(t) - 1 if kind in MONTHS else seconds


def _moment(ordinal: Column, kind: str) -> Column:
    """The seconds of an ordinal; what lies before year 1 is its beginning."""
    if kind in SECONDS:
        return ordinal
    months = F.greatest(F.lit(12), ordinal)
    return F.unix_seconds(F.make_timestamp(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def interval_ticks(spark: SparkSession, low: float, high: float, wanted: int, kind: str, step: int) -> DataFrame:
    """t (seconds), label of about `wanted` ticks between two moments, all of them beginnings of bins of this rung; none for a rung of uneven bins.

    The bins are rows with their numbers, and so are the distances that ticks may have:
    parts of the next larger unit, and 1, 2 and 5 times powers of ten of it.  An
    aggregate takes the distance that brings the nearest number of ticks, as a ratio.
    """
    if not uniform(kind, step):
        return spark.createDataFrame([], "t long, label string")
    size = (MONTHS.get(kind) or SECONDS[kind]) * step
    number = lambda at: F.floor(_ordinal(F.lit(at), kind) / size)
    bins = spark.range(1).select(F.explode(F.sequence(number(low), number(high))).alias("bin"))
    bins = bins.withColumn("t", _moment(F.col("bin") * size, kind).cast("double")).filter(F.col("t").between(low, high))
    cycle = CYCLE.get(kind, step)
    parts = F.filter(F.sequence(F.lit(step), F.lit(max(cycle, step)), F.lit(step)), lambda d: (F.lit(cycle) % d == 0) | (d == step))
    powers = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda p: F.transform(F.array(F.lit(1), F.lit(2), F.lit(5)), lambda k: (F.pow(F.lit(10), p) * k * cycle).cast("long"))))
    strides = spark.range(1).select(F.explode(F.array_union(parts.cast("array<bigint>"), F.filter(powers, lambda m: m % step == 0))).alias("stride"))
    span = bins.agg((F.max("bin") - F.min("bin")).alias("span"))
    ticks = F.floor(F.col("span") * step / F.col("stride")) + 1
    off = F.abs(F.log(ticks / F.lit(float(max(1, wanted)))))
    best = strides.join(span, F.lit(True)).agg(F.min_by("stride", F.struct(off.alias("off"), "stride")).alias("best"))  # a few rows by one
    kept = bins.join(best, F.col("bin") % F.greatest(F.lit(1), F.round(F.col("best") / step)) == 0)
    return kept.select(F.col("t").cast("long").alias("t")).distinct().withColumn("label", F.date_format(F.timestamp_seconds("t"), _LABEL[kind])).orderBy("t")


def year_ticks(spark: SparkSession, low: float, high: float, wanted: int) -> DataFrame:
    """t (seconds), label of the years on the step that brings about `wanted` ticks."""
    ends = spark.range(1).select(F.year(F.timestamp_seconds(F.lit(low))).alias("a"), F.year(F.timestamp_seconds(F.lit(high))).alias("b"))
    steps = ends.withColumn("step", F.explode(F.array(*map(F.lit, YEAR_STEPS))))
    off = F.abs(F.log(F.col("step") * max(1, wanted) / F.greatest(F.lit(1), F.col("b") - F.col("a"))))
    one = steps.groupBy("a", "b").agg(F.min_by("step", F.struct(off.alias("off"), "step")).alias("step"))
    first = F.greatest(F.ceil(F.col("a") / F.col("step")) * F.col("step"), F.when(F.col("step") == 1, 1).otherwise(F.col("step"))).cast("int")
    years = one.filter(first <= F.col("b")).select(F.explode(F.sequence(first, "b", "step")).alias("y"))
    return years.select(F.unix_seconds(F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("t"), F.col("y").cast("string").alias("label")).orderBy("t")


def axis_ticks(spark: SparkSession, low: float, high: float, wanted: int, rung: tuple[str, int] | None) -> DataFrame:
    """Ticks on the layout's bins; on years where it names none or no bin begins in view."""
    found = interval_ticks(spark, low, high, wanted, *rung) if rung else None
    return found if found is not None and not found.isEmpty() else year_ticks(spark, low, high, wanted)
