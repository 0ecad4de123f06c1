"""What a table's columns look like: types, samples, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import ellipsis

#: The most rows of a page.
PAGE = 10_000


def first_row(df: DataFrame, key: str = "id") -> DataFrame:
    """The row of the least key as one row (ties: the least row), found by an aggregate, not a sort; any first row where there is no key."""
    if key not in df.columns:
        return df.limit(1)
    return df.filter(F.col(key).isNotNull()).agg(F.min_by(F.struct(*df.columns), key).alias("r")).filter("r is not null").select("r.*")


def column_profile(df: DataFrame, key: str = "id") -> DataFrame:
    """name, type, sample (of the first row, cut at 160 signs) of each column, in order; samples are null in an empty table."""
    texts = [F.struct(F.lit(i).alias("at"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), ellipsis(F.col(f"`{f.name}`").cast("string")).alias("sample")) for i, f in enumerate(df.schema.fields)]
    kinds = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "at int, name string, type string")
    shown = first_row(df, key).select(F.inline(F.array(*texts))).select("at", "sample")
    return kinds.join(shown, "at", "left").orderBy("at").select("name", "type", "sample")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset … offset + limit of the sorted table, each with the table's total."""
    if offset < 0 or not 0 < limit <= PAGE:
        raise ValueError(f"a page begins at 0 or later and has 1 to {PAGE} rows")
    return df.orderBy(order).offset(offset).limit(limit).withColumn("total", F.lit(df.count()).cast("long"))
