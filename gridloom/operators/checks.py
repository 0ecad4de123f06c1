"""Checks of data and roles before a layout is made: each returns rows, one a finding, from one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import finite, to_number

#: Bounds of degrees, and the latitude at which the Mercator map is cut.
LONGITUDE, LATITUDE, MERCATOR_LATITUDE = 180.0, 90.0, 85.051129
#: Fixed value: bounds of values that pass through as they are.
UNIT = (0.0, 1.0)


@dataclass(frozen=True)
class Pair:
    """Two coordinate columns: scales linear or log, normalize fit or none, projection equirectangular or mercator."""

    x: str
    y: str
    x_scale: str = "linear"
    y_scale: str = "linear"
    normalize: str = "fit"
    projection: str = "equirectangular"


def _reads(c: Column, kind: str) -> Column:
    """c, as text, read as kind; null where it can't be."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    if kind == "number":
        n = to_number(text)
        return F.when(finite(n), n)
    return text.try_cast("timestamp" if kind == "iso8601" else "bigint")


def parse_counts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """column, n_values (not blank), n_parsed, whole (all of them parse) of columns that must read as iso8601, unix_seconds, unix_millis or number."""
    found = [
        F.struct(F.lit(c).alias("column"), F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias("n_values"), F.count(_reads(F.col(c), k)).alias("n_parsed"))
        for c, k in kinds.items()
    ]
    rows = df.agg(F.array(*found).alias("f")).select(F.inline("f"))
    return rows.withColumn("whole", F.col("n_values") == F.col("n_parsed"))


def strict(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the columns cast to their kinds, once parse_counts finds that every value parses; else an error that names the column."""
    bad = parse_counts(df, kinds).filter("not whole").select("column").first()
    if bad:
        raise ValueError(f"{bad['column']}: values do not all parse as {kinds[bad['column']]}")
    return df.withColumns({c: _reads(F.col(c), k) for c, k in kinds.items()})


def _ends(pair: Pair, column: str) -> tuple[Column, Column]:
    """Least and greatest of a column over the rows that have both coordinates."""
    both = finite(F.col(pair.x)) & finite(F.col(pair.y))
    return F.min(F.when(both, F.col(column))), F.max(F.when(both, F.col(column)))


def _findings(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """column, rule, value of (column, rule, offending value or null) aggregates, all from one scan."""
    if not rules:
        return df.sparkSession.createDataFrame([], "column string, rule string, value double")
    rows = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), v.cast("double").alias("value")) for c, r, v in rules]).alias("f"))
    return rows.select(F.inline("f")).filter("value is not null")


def _outside(low: Column, high: Column, least: float, most: float) -> Column:
    """The extreme that lies outside least … most, the low one first."""
    return F.when(low < least, low).when(high > most, high)


def coordinate_findings(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Log axes with values of 0 or less, and pass-through axes with values outside 0 … 1; rows without both coordinates are exempt."""
    rules = []
    for p in pairs:
        for column, scale in ((p.x, p.x_scale), (p.y, p.y_scale)):
            low, high = _ends(p, column)
            if scale == "log":
                rules.append((column, "log", F.when(low <= 0, low)))
            if p.normalize == "none":
                rules.append((column, "unit", _outside(low, high, *UNIT)))
    return _findings(df, rules)


def degree_findings(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Longitudes beyond 180, latitudes beyond 90, and under mercator latitudes beyond the map's cut."""
    rules = []
    for p in pairs:
        lon, lat = _ends(p, p.x), _ends(p, p.y)
        rules += [(p.x, "longitude", _outside(*lon, -LONGITUDE, LONGITUDE)), (p.y, "latitude", _outside(*lat, -LATITUDE, LATITUDE))]
        if p.projection == "mercator":
            rules.append((p.y, "mercator", _outside(*lat, -MERCATOR_LATITUDE, MERCATOR_LATITUDE)))
    return _findings(df, rules)


def _wanted(kind: str, found: T.DataType) -> str | None:
    """The type that a role's stored column should have, where it hasn't."""
    if kind == "datetime" and not isinstance(found, T.TimestampType | T.TimestampNTZType):
        return "timestamp"
    if kind in ("scatter", "geographic") and not isinstance(found, T.DoubleType | T.FloatType):
        return "float"
    if kind == "tag" and not isinstance(found, T.ArrayType):
        return "list"
    return None


def role_findings(df: DataFrame, roles: list[tuple[str, ...]]) -> DataFrame:
    """role, column, finding (missing, the type it should have, or iso8601) of (role, column) or (role, column, form) against df's schema; no scan.

    A stored time has no form but iso8601: numbers have been read as what they count by then.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = []
    for kind, c, *form in roles:
        wrong = "missing" if c not in types else _wanted(kind, types[c])
        found.append((kind, c, wrong or ("iso8601" if kind == "datetime" and form and form[0] != "iso8601" else None)))
    return df.sparkSession.createDataFrame([x for x in found if x[2]], "role string, column string, finding string")
