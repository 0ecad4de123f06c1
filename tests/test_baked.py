"""Stored layouts, their key ranges, roll-ups and ranks in hot groups, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import baked, ids, layouts, pyramid, view

CELLS = "id long, x double, y double, w double, h double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    spread = [(rng.random(), rng.random()) for _ in range(3000)]
    pile = [(0.3 + rng.random() * 1e-5, 0.7 + rng.random() * 1e-6) for _ in range(1500)] + [(0.25, 0.25)] * 300
    return [(i, x, y, 0.004 + 0.002 * (i % 3), 0.003) for i, (x, y) in enumerate(spread + pile)]


@pytest.fixture(scope="module")
def stored(spark, rows):
    return baked.bake(spark.createDataFrame(rows, CELLS).repartition(5))


def over(view_, r):
    return r[1] + r[3] / 2 > view_[0] and r[1] - r[3] / 2 < view_[2] and r[2] + r[4] / 2 > view_[1] and r[2] - r[4] / 2 < view_[3]


def test_a_stored_layout_holds_each_cell_once(spark, rows, stored):
    assert sorted(tuple(r) for r in stored.cells(spark).select("id", "x", "y", "w", "h").collect()) == sorted(rows)
    assert baked.opened(spark, stored.path) == stored and stored.n == len(rows)
    assert stored.box == pyramid.bbox(spark.createDataFrame(rows, CELLS))


def test_views_read_key_ranges(spark, rows, stored):
    rng = random.Random(9)
    views = [(0.0, 0.0, 1.0, 1.0), (0.3, 0.7, 0.3, 0.7), (2.0, 2.0, 3.0, 3.0), (0.6, 0.6, 0.5, 0.7), (-1.0, 0.2, 0.1, 5.0)]
    for _ in range(12):
        x, y, s = rng.random(), rng.random(), rng.random() ** 3
        views.append((x, y, x + s, y + s * rng.random()))
    for v in views:
        found = baked.ranges(stored.box, (v[0] - stored.w / 2, v[1] - stored.h / 2, v[2] + stored.w / 2, v[3] + stored.h / 2))
        assert len(found) <= baked.RANGES and all(a <= b for a, b in found)
        got = {r["id"] for r in stored.near(spark, v).filter(view.overlaps(v)).select("id").collect()}
        assert got == {r[0] for r in rows if over(v, r)}, v
    small = (0.5, 0.5, 0.52, 0.52)
    assert stored.near(spark, small).count() < 60  # of 4,800
    plan = stored.near(spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or" in plan.replace("\n", "") and "GreaterThanOrEqual(key" in plan


def test_tiles_are_one_range(spark, rows, stored):
    x0, y0, x1, y1 = stored.box
    n = 8
    for tx, ty in ((0, 0), (2, 5), (7, 7)):
        want = {r[0] for r in rows if (min(n - 1, int((r[1] - x0) / (x1 - x0) * n)), min(n - 1, int((r[2] - y0) / (y1 - y0) * n))) == (tx, ty)}
        assert {r["id"] for r in baked.in_tile(stored, spark, 3, tx, ty).collect()} == want


@pytest.mark.parametrize("deepest", [3, 8, 11, 24])
def test_roll_up_equals_counts_of_each_level(spark, rows, stored, deepest):
    x0, y0, x1, y1 = stored.box
    fine = pyramid.coarser(stored.spots(spark), pyramid.DEEPEST, deepest)
    runs = pyramid.roll_up(fine, deepest).collect()
    assert len(runs) < 2 * fine.count() + 9000
    got = defaultdict(Counter)
    ends = {}
    for r in runs:
        for z in range(r["z"], r["z_to"] + 1):
            tile = r["tx"] >> r["z_to"] - z, r["ty"] >> r["z_to"] - z
            got[z][tile] += r["n"]
            assert (z, tile) not in ends
            ends[z, tile] = r["ax"], r["bx"], r["ay"], r["by"]
    for z in range(deepest + 1):
        n, want, held = 1 << z, Counter(), defaultdict(list)
        for r in rows:
            tile = min(n - 1, int((r[1] - x0) / (x1 - x0) * n)), min(n - 1, int((r[2] - y0) / (y1 - y0) * n))
            want[tile] += 1
            held[tile].append(r)
        assert got[z] == want, z
        assert all(ends[z, t] == (min(r[1] for r in h), max(r[1] for r in h), min(r[2] for r in h), max(r[2] for r in h)) for t, h in held.items())
    summary = {r["z"]: r for r in pyramid.level_summary(pyramid.roll_up(fine, deepest), 4, stored.box, stored.w, stored.h, deepest).collect()}
    whole = {r["z"]: r for r in pyramid.level_summary(pyramid.each_level(pyramid.roll_up(fine, deepest)), 4, stored.box, stored.w, stored.h, deepest).collect()}
    assert summary == whole and len(summary) == deepest + 1


def test_an_empty_layout(spark):
    none = baked.bake(spark.createDataFrame([], CELLS))
    assert none.n == 0 and none.near(spark, (0, 0, 1, 1)).count() == 0 and pyramid.roll_up(none.spots(spark)).count() == 0
    assert pyramid.settle(none.spots(spark), 0, 4, none.box, none.w, none.h) == (0, "empty")


def test_ranks_in_a_hot_group(spark):
    rng = random.Random(2)
    data = [(i, "hot" if i % 10 else f"g{i % 70}", rng.randrange(500)) for i in range(4000)]
    df = spark.createDataFrame(data, "id long, g string, t long").repartition(7)
    want, groups = {}, defaultdict(list)
    for i, g, t in data:
        groups[g].append((t, i))
    for g, members in groups.items():
        want |= {(g, i): k for k, (_, i) in enumerate(sorted(members))}
    for largest in (None, 4000):
        got = ids.ranks_within(df, "g", "t", "id", largest=largest, name="k")
        assert got.columns == ["id", "g", "t", "k"] and {(r["g"], r["id"]): r["k"] for r in got.collect()} == want
    counts = ids.ranks_within(df, "g", "t", "id").groupBy(F.spark_partition_id().alias("p")).count()
    assert ids.ranks_within(df.limit(0), "g", "id").count() == 0 and counts.count() >= 1


def test_layouts_of_hot_groups_do_not_depend_on_the_path(spark, monkeypatch):
    items = spark.createDataFrame([(i, "hot" if i % 9 else str(i), 86400 * (i % 5) if i % 3 else 0) for i in range(900)], "id long, v string, t long").repartition(6)
    one = sorted(map(tuple, layouts.treemap_cells(items, "v").collect()))
    two = sorted(map(tuple, layouts.histogram(items, "t", "unix_seconds")[0].collect()), key=str)
    monkeypatch.setattr(ids, "GROUP", 1)
    assert sorted(map(tuple, layouts.treemap_cells(items, "v").collect())) == one
    assert sorted(map(tuple, layouts.histogram(items, "t", "unix_seconds")[0].collect()), key=str) == two


def test_the_lineitem_layout_has_unique_ids(spark):
    from gridloom.plans import queries

    cells = queries._lines(lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet"))
    n = cells.count()
    assert cells.select("id").distinct().count() == n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert cells.agg(F.min("id"), F.max("id")).first()[:] == (0, n - 1)


def test_a_block_stands_one_cell_below_the_data(spark):
    items = spark.createDataFrame([(i, 0.1 + 0.01 * i if i < 20 else None, 0.2 + 0.005 * i) for i in range(27)], "id long, px double, py double")
    got = {r["id"]: r for r in layouts.scatter(items, normalize="none").collect()}
    side, low = got[0]["w"], max(got[i]["y"] for i in range(20))
    assert [got[20 + j]["placed"] for j in range(7)] == [False] * 7
    for j in range(7):
        assert got[20 + j]["x"] == pytest.approx(0.1 * 0.95 + (j % 3 + 0.5) * side) and got[20 + j]["y"] == pytest.approx(low + side + (j // 3 + 0.5) * side)
    full = layouts.scatter(items.withColumn("py", F.col("py") * 3.2), normalize="none").filter("not placed").agg(F.min("y")).first()[0]
    assert full > layouts.STRIP
