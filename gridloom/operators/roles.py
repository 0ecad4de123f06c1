"""Column roles: what they project, how they name layouts, and the prints by which a layout is known to be stale."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import split_tags, to_number
from gridloom.operators import layouts
from gridloom.sources.tables import stored

FAMILIES = ("categorical", "scatter", "geographic")


@dataclass(frozen=True)
class Role:
    """One declared role: its kind, its column or pair of columns, a label, and the options that say how to read it."""

    kind: str
    columns: tuple[str, ...]
    label: str = ""
    options: dict[str, str] = field(default_factory=dict)


def project(df: DataFrame, key: str, roles: list[Role]) -> DataFrame:
    """_key and each role's columns once: times parsed, coordinates as doubles (blank: null), tags as lists, the rest as text."""
    out: dict[str, Column] = {}
    for r in roles:
        for c in r.columns:
            if r.kind == "datetime":
                made = F.col(c).cast("timestamp" if r.options.get("format", "iso8601") == "iso8601" else "bigint")
            elif r.kind in ("scatter", "geographic"):
                made = to_number(F.nullif(F.col(c).cast("string"), F.lit("")))
            elif r.kind == "tag":
                made = split_tags(F.col(c), r.options.get("delimiter"))
            else:
                made = F.col(c).cast("string")
            out.setdefault(c, made)
    return df.select(F.col(key).alias("_key"), *[v.alias(c) for c, v in out.items()])


def first_free(names: Iterable[str], taken: set[str]) -> str:
    """The first name that is not taken, which is taken from then on."""
    name = next(n for n in names if n not in taken)
    taken.add(name)
    return name


def reserved_names(columns: list[str], reserved: set[str]) -> dict[str, str]:
    """New names of the columns that shadow a reserved one: meta_ before it, and underscores until it is free."""
    taken = reserved | set(columns)
    return {c: first_free(("_" * k + "meta_" + c for k in count()), taken) for c in columns if c in reserved}


def renamed_roles(roles: list[Role], names: dict[str, str]) -> list[Role]:
    return [replace(r, columns=tuple(names.get(c, c) for c in r.columns)) for r in roles]


def slug(column: str) -> str:
    return re.sub("[^a-z0-9._-]+", "-", column.lower())


def layout_names(roles: list[Role]) -> list[tuple[str, Role | None]]:
    """(layout_id, role) of the layouts that roles can produce: the grid, a calendar, and one a member of each family.

    A family's only member has its bare name, several have the slug of their first
    column behind it; equal slugs are told apart by a number.
    """
    def members(family: str) -> list[tuple[str, Role]]:
        own, taken = [r for r in roles if r.kind == family], set()
        stems = [family if len(own) == 1 else f"{family}_{slug(r.columns[0])}" for r in own]
        return [(first_free(chain([stem], (f"{stem}-{k}" for k in count(i))), taken), r) for i, (stem, r) in enumerate(zip(stems, own, strict=True))]

    return [("grid", None), *(("datetime", r) for r in roles if r.kind == "datetime"), *(m for family in FAMILIES for m in members(family))]


#: A layout's maker: items (id and the role's columns) and the role give cells (id, x, y, w, h).
Maker = Callable[[DataFrame, Role | None], DataFrame]
MAKERS: dict[str, Maker] = {}


def layout(kind: str) -> Callable[[Maker], Maker]:
    """Registers a maker of layouts of this kind; another one of the same kind replaces it."""

    def add(f: Maker) -> Maker:
        MAKERS[kind] = f
        return f

    return add


@layout("grid")
def _grid(items: DataFrame, role: Role | None) -> DataFrame:
    return layouts.grid(items)


@layout("datetime")
def _calendar(items: DataFrame, role: Role | None) -> DataFrame:
    assert role
    return layouts.histogram(items, role.columns[0], role.options.get("format", "iso8601"))[0]


@layout("categorical")
def _categories(items: DataFrame, role: Role | None) -> DataFrame:
    assert role
    return layouts.treemap_cells(items, role.columns[0])


@layout("scatter")
def _scatter(items: DataFrame, role: Role | None) -> DataFrame:
    assert role
    return layouts.scatter(items, *role.columns, log=role.options.get("scale") == "log", normalize=role.options.get("normalize", "fit"))


@layout("geographic")
def _map(items: DataFrame, role: Role | None) -> DataFrame:
    assert role
    return layouts.geographic(items, *role.columns, mercator=role.options.get("projection") == "mercator")


def expanded(items: DataFrame, roles: list[Role]) -> DataFrame:
    """layout_id, id, x, y, w, h of every layout that the roles produce, each item in each of them once."""
    out = None
    for name, role in layout_names(roles):
        cells = MAKERS[role.kind if role else "grid"](items, role).select(F.lit(name).alias("layout_id"), "id", "x", "y", "w", "h")
        out = cells if out is None else out.unionByName(cells)
    assert out is not None
    return out


def prints(entries: DataFrame) -> DataFrame:
    """entry, column, print of role entries (entry, kind, columns, options): what changes how the entry reads the column.

    The kind and options, and for a pair the axis and the other column; a pair of one
    column twice has two prints of it.  Labels are no part of it.
    """
    pair = F.col("kind").isin("scatter", "geographic")
    axis = F.transform("columns", lambda c, i: F.struct(c.alias("column"), F.when(pair, F.array(F.when(i == 0, "first").otherwise("second"), F.get("columns", F.lit(1) - i))).otherwise(F.array().cast("array<string>")).alias("axis")))
    rows = entries.select("entry", "kind", "options", F.explode(axis).alias("a"))
    return rows.select("entry", F.col("a.column").alias("column"), F.to_json(F.concat(F.array("kind"), F.col("a.axis"), F.coalesce("options", F.array().cast("array<string>")))).alias("print"))


def declared_columns(docs: DataFrame, key: str, json: str) -> DataFrame:
    """key, columns (distinct, sorted) that each JSON document names under keys `column` or `…_column`, however deep; what is no JSON names none.

    Documents are taken apart as variants, a level a round, so a name inside a text, an
    escaped quote or a list of lists is what it is; a value that is no text is searched on.
    """
    spark = docs.sparkSession
    level = stored(docs.select(key, F.col(json).alias("_json")))
    found = []
    while not level.isEmpty():
        parsed = level.select(key, F.try_parse_json("_json").alias("_v")).alias("p")
        parts = parsed.lateralJoin(spark.tvf.variant_explode(F.col("p._v").outer())).select(key, F.col("key").alias("_name"), F.col("value").alias("_value"))
        kind = F.schema_of_variant("_value")
        named = F.coalesce((F.col("_name") == "column") | F.endswith("_name", F.lit("_column")), F.lit(False)) & (kind == "STRING")
        parts = stored(parts.select(key, F.when(named, F.try_variant_get("_value", "$", "string")).alias("_column"), F.when(~named & kind.rlike("^(OBJECT|ARRAY)"), F.to_json("_value")).alias("_json")))
        found.append(parts.filter("_column is not null").select(key, "_column"))
        level = parts.filter("_json is not null").select(key, "_json")
    named = reduce(DataFrame.union, found) if found else docs.select(key, F.lit("").alias("_column")).limit(0)
    named = named.groupBy(key).agg(F.array_sort(F.collect_set("_column")).alias("columns"))
    return docs.select(key).join(named, key, "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))


PAIRS = ("scatter", "geographic")


def role_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """dataset, n: how many edits lead from one set of role entries to another; datasets that change nothing are not named.

    before, after: dataset, entry, kind, column, print, a row for each column that an
    entry reads (see prints()).  In each family of pairs the greater of the readings
    that left and those that arrived counts, as a set of distinct ones, each the prints
    of all its columns.  Every other changed column counts once.  An axis of a pair
    that left or arrived counts again only where its own roles changed: any gained, or
    any lost but `freeform` of a column that is an axis now.
    """
    side = before.withColumn("_new", F.lit(False)).unionByName(after.withColumn("_new", F.lit(True)))
    side = side.withColumn("_pair", F.col("kind").isin(*PAIRS))
    entries = side.filter("_pair").groupBy("dataset", "_new", "entry", "kind").agg(F.array_sort(F.collect_set(F.struct("column", "print"))).alias("reading"))
    # a reading that one side has only
    moved = entries.groupBy("dataset", "kind", "reading").agg(F.bool_or("_new").alias("is_new"), F.bool_or(~F.col("_new")).alias("was")).filter("is_new != was")
    pairs = moved.groupBy("dataset", "kind").agg(F.greatest(F.count_if("was"), F.count_if("is_new")).alias("n")).groupBy("dataset").agg(F.sum("n").alias("n"))
    axes = moved.select("dataset", F.explode("reading.column").alias("column")).distinct().withColumn("axis", F.lit(True))
    prints_ = side.groupBy("dataset", "column", "kind", "_pair", "print").agg(F.bool_or("_new").alias("is_new"), F.bool_or(~F.col("_new")).alias("was"))
    now_axis = F.bool_or(F.col("_pair") & F.col("is_new"))
    columns = prints_.groupBy("dataset", "column").agg(
        F.bool_or(F.col("is_new") != F.col("was")).alias("changed"), now_axis.alias("now_axis"),
        F.bool_or(~F.col("_pair") & F.col("is_new") & ~F.col("was")).alias("gained"),
        F.bool_or(~F.col("_pair") & ~F.col("is_new") & F.col("was") & (F.col("kind") != "freeform")).alias("lost"),
        F.bool_or(~F.col("_pair") & ~F.col("is_new") & F.col("was") & (F.col("kind") == "freeform")).alias("lost_freeform"),
    ).filter("changed")
    own = F.col("gained") | F.col("lost") | (F.col("lost_freeform") & ~F.col("now_axis"))
    alone = columns.join(axes, ["dataset", "column"], "left").groupBy("dataset").agg(F.count_if(F.col("axis").isNull() | own).alias("m"))
    return alone.join(pairs, "dataset", "left").select("dataset", (F.col("m") + F.coalesce("n", F.lit(0))).alias("n"))


def stale_knobs(committed: DataFrame, override: DataFrame, kept: DataFrame, printed: DataFrame) -> DataFrame:
    """dataset, pair, layout_id, exact of each dataset whose override must be refused: it changes a pair's knobs under a layout that would not tell.

    committed: dataset, seq, layout_id, pair, knobs; override: dataset, seq, pair, knobs;
    kept: dataset, layout_id of committed layouts that are not baked again; printed:
    those that record prints, and so tell that they are stale themselves.  An override
    is held against the pair's last kept entry; the layout named is the last one of the
    pair without prints, and the first such override by seq is the one named.  exact:
    the pair is declared once on both sides, so it is that layout's own knobs that
    changed.
    """
    keys = ["dataset", "layout_id"]
    held = committed.join(kept.select(*keys).distinct(), keys, "left_semi").join(printed.select(*keys).distinct().withColumn("_told", F.lit(True)), keys, "left")
    silent = F.col("_told").isNull()
    last = held.groupBy("dataset", "pair").agg(F.max_by("knobs", "seq").alias("_knobs"), F.max_by(F.when(silent, F.col("layout_id")), F.when(silent, F.col("seq"))).alias("layout_id")).filter("layout_id is not null")
    once = lambda df: df.groupBy("dataset", "pair").agg((F.count(F.lit(1)) == 1).alias("once"))
    changed = override.join(last, ["dataset", "pair"]).filter(~F.col("knobs").eqNullSafe(F.col("_knobs")))
    first = changed.groupBy("dataset").agg(F.min_by(F.struct("pair", "layout_id"), "seq").alias("f")).select("dataset", "f.*")
    sure = once(committed).withColumnRenamed("once", "_a").join(once(override).withColumnRenamed("once", "_b"), ["dataset", "pair"])
    return first.join(sure, ["dataset", "pair"]).select("dataset", "pair", "layout_id", (F.col("_a") & F.col("_b")).alias("exact"))
