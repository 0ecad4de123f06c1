"""The reference operators against SQL, and their invariants."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.functions import columns as C
from gridloom.operators import catalog, checks, ids, layouts, positions, profile, pyramid, ranks, roles, search, ticks, view
from gridloom.plans.queries import ORACLE_SQL, QUERIES
from gridloom.sources import tables
from gridloom.streaming import stream

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(float(r[names.index(c)])) if type(r[names.index(c)]).__name__ == "Decimal" else plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(abs(x - y) < 2e-5 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_treemap_tiles_the_unit_square(spark):
    counts = spark.createDataFrame([("a", 6), ("b", 6), ("c", 4), ("d", 3), ("e", 2), ("f", 2), ("g", 1)], "value string, n long")
    rows = layouts.treemap_rects(counts).collect()
    assert sum(r["w"] * r["h"] for r in rows) == pytest.approx(1)
    first = {r["value"]: r for r in rows}
    # the classic example: the two largest share the first band
    assert (first["a"]["w"], first["a"]["h"]) == pytest.approx((0.5, 0.5)) and first["b"]["y0"] != first["a"]["y0"] or first["b"]["x0"] != first["a"]["x0"]
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            across = min(a["x0"] + a["w"], b["x0"] + b["w"]) - max(a["x0"], b["x0"])
            down = min(a["y0"] + a["h"], b["y0"] + b["h"]) - max(a["y0"], b["y0"])
            assert across < 1e-9 or down < 1e-9


def test_histogram_of_daily_rows(spark):
    items = spark.range(256).select("id", F.expr("timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(id)").alias("t"))
    cells, axis = layouts.histogram(items, "t")
    assert (axis["kind"], axis["step"], axis["k"]) == ("month", 1, 2)
    assert axis["range"] == pytest.approx([0.04, 0.874525093], abs=1e-9)
    assert cells.count() == 256
    assert pyramid.bbox(cells)[0] == pytest.approx(0.043205, abs=1e-6)


def test_layouts_keep_every_item(spark):
    items = spark.range(50).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("px"), (F.col("id") * F.col("id")).cast("double").alias("py"))
    cells = layouts.scatter(items)
    assert cells.count() == 50 and cells.filter("not placed").count() == 8
    assert cells.filter("not placed and (y < 0.96 or y > 1)").count() == 0


def test_rollup_equals_direct_binning(spark):
    cells = spark.range(3000).select("id", F.rand(3).alias("x"), F.rand(4).alias("y")).withColumn("w", F.lit(0.001)).withColumn("h", F.lit(0.001)).cache()
    box = pyramid.bbox(cells)
    for z in (0, 3, 9):
        direct = {(r["tx"], r["ty"], r["count"]) for r in pyramid.tiled(cells, box, z).groupBy("tx", "ty").count().collect()}
        assert {(r["tx"], r["ty"], r["n"]) for r in pyramid.levels(cells, box).filter(f"z = {z}").collect()} == direct


def test_ids_are_dense_and_ties_resolve(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = ids.dense_ids(df, "k").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1000)) and [r["k"] for r in rows] == list(range(1000))


def test_pick_prefers_the_higher_id(spark):
    cells = spark.createDataFrame([(1, 0.5, 0.5, 0.2, 0.2), (2, 0.5, 0.5, 0.2, 0.2), (3, 0.9, 0.9, 0.1, 0.1)], "id long, x double, y double, w double, h double")
    assert view.pick(cells, 0.5, 0.5).first()["id"] == 2
    assert view.pick(cells, 0.2, 0.2).first() is None


def test_limiter_windows_open_at_the_first_event(spark):
    e = spark.createDataFrame([("a", s) for s in (0, 10, 59, 60, 61, 200)] + [("b", 5)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["key"]: (r["windows"], r["events"], r["rejected"]) for r in stream.limited(e, "k", "ts", 2, 60).collect()}
    assert got == {"a": (3, 6, 1), "b": (1, 1, 0)}


def test_staleness_states(spark):
    dec = spark.createDataFrame([("k", "f1"), ("k", "f2")], "key string, fingerprint string")
    bak = spark.createDataFrame([("a", "k", "f1"), ("b", "k", "f1"), ("b", "k", "f1"), ("c", "k", None), ("d", None, None)], "layout_id string, key string, fingerprint string")
    assert {r["layout_id"]: r["state"] for r in catalog.stale_layouts(dec, bak).collect()} == {"a": "fresh", "b": "stale", "c": "unknown", "d": "never"}


def test_formats(spark):
    rows = spark.createDataFrame([(999,), (1500,), (12000,), (1500000,)], "n long").select(C.short_count(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["999", "1.5k", "12k", "1.5M"]


def test_ranks_equal_a_sort(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 20)
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("a"), F.floor(F.col("id") / 1000).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    assert ranks.medians(df, ["a", "b", "c"]) == [2499.5, 2.0, None]
    assert ranks.ranked(df, {"a": 0.5}, upper=True)["a"] == (2500.0, 2500.0)
    assert view.upper_median(df, "c").count() == 0


@pytest.mark.parametrize("undated", [0, 1, 7, 2000])
def test_undated_items_fit_the_strip(spark, undated):
    dated = spark.range(200).select("id", F.expr("timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(id)").alias("t"))
    items = dated.union(spark.range(1000, 1000 + undated).select("id", F.lit(None).cast("timestamp_ntz").alias("t")))
    cells, axis = layouts.histogram(items, "t")
    alone, same = layouts.histogram(dated, "t")
    assert cells.count() == 200 + undated and axis == same
    assert cells.filter("y + h / 2 > 1 + 1e-12 or x + w / 2 > 1 + 1e-12 or (not dated and y - h / 2 < 0.96 - 1e-12)").count() == 0
    if undated:  # no larger side fits
        w = cells.filter("not dated").first()["w"]
        assert w == axis["side"] or math.ceil(undated / math.floor(1 / (w * 1.001))) * w * 1.001 > 0.04


def test_times_as_numbers_and_beyond_calendars(spark):
    seconds = spark.range(100).select("id", (F.col("id") * 86400 + 1_600_000_000).alias("s"), ((F.col("id") * 86400 + 1_600_000_000) * 1000).alias("ms"))
    a, axis = layouts.histogram(seconds, "s", "unix_seconds")
    b, same = layouts.histogram(seconds, "ms", "unix_millis")
    assert axis == same and axis["kind"] == "month" or axis["kind"] == "day"
    assert a.join(b.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")), "id").filter("abs(x - x1) > 1e-9 or abs(y - y1) > 1e-9").count() == 0
    wild, none = layouts.histogram(seconds, "ms", "unix_seconds")  # the year 52,000
    assert none == {} and wild.count() == 100 and wild.filter("x < 0 or x > 1 or y < 0 or y > 0.96").count() == 0
    one, none = layouts.histogram(seconds.withColumn("s", F.lit(5)), "s", "unix_seconds")
    assert none == {} and one.count() == 100 and one.select("x").distinct().count() == 1


def test_bin_width_is_the_best_of_all(spark):
    for deepest, span, least, gap in ((5, 10.0, 1.0, 1.0), (40, 300.0, 28.0, 28.0), (17, 9.0, 2.0, 1.9), (1, 1.0, 1.0, 1.0)):
        k, pitch = layouts.bin_width(spark, deepest, span, least, gap)
        most = deepest if gap >= least else max(1, min(deepest, int(0.25 * gap / least / (1 - gap / least))))
        every = [min(0.92 / (j * (span / least + 1) + 0.25 * span / least), 0.96 / math.ceil(deepest / j)) for j in range(1, most + 1)]
        assert pitch == max(every) and k == every.index(max(every)) + 1


def test_levels_stop_for_the_right_reason(spark):
    def stop(rows, w, h, cap=4):
        cells = spark.createDataFrame([(i, float(x), float(y), w, h) for i, (x, y) in enumerate(rows)], "id long, x double, y double, w double, h double")
        box = pyramid.bbox(cells)
        whole = pyramid.choose_z(pyramid.level_summary(pyramid.levels(cells, box), cap, box, w, h), len(rows), cap, box, w, h)
        assert pyramid.settle(pyramid.spots(cells, box), len(rows), cap, box, w, h) == whole
        return whole

    grid = [((i + 0.5) / 16, (j + 0.5) / 16) for i in range(16) for j in range(16)]
    assert stop(grid, 0.05, 0.05) == (3, "fits")
    assert stop([(0.5, 0.5)] * 9 + [(0.1, 0.1)], 1e-4, 1e-4)[1] == "coincident"
    near = [(0.1, 0.1), (0.9, 0.9)] + [(0.5 + i * 1e-9, 0.5) for i in range(9)]  # nearer than the deepest tile
    assert stop(near, 1e-3, 1e-3)[1] == "coincident"
    pile = [(0.1, 0.1), (0.9, 0.9)] + [(0.5 + i * 1e-4, 0.5) for i in range(40)]
    assert stop(pile, 0.1, 0.1) == (3, "ceiling")
    # laid out side by side in a narrow box: the ceiling yields and every cell is kept
    narrow = [(0.5 + (i % 2) * 0.01, (i + 0.5) / 200) for i in range(200)]
    assert stop(narrow, 0.009, 0.0045)[1] == "fits"
    assert stop([], 0.1, 0.1) == (0, "empty")


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([("2020-01-01", "3", 1.0, 0.5), ("x", "", -2.0, None), (None, "4e1", 0.0, 2.0)], "t string, n string, a double, b double")
    got = {r["column"]: (r["n_values"], r["n_parsed"], r["whole"]) for r in checks.parse_counts(df, {"t": "iso8601", "n": "number"}).collect()}
    assert got == {"t": (2, 1, False), "n": (2, 2, True)}
    with pytest.raises(ValueError, match="t: values"):
        checks.strict(df, {"t": "iso8601"})
    assert [r["n"] for r in checks.strict(df, {"n": "number"}).collect()] == [3.0, None, 40.0]
    found = {(r["column"], r["rule"]): r["value"] for r in checks.coordinate_findings(df, [checks.Pair("a", "b", x_scale="log", normalize="none")]).collect()}
    assert found == {("a", "log"): 0.0, ("b", "unit"): 2.0}  # -2 has no partner
    far = spark.createDataFrame([(181.0, 86.0), (0.0, -91.0), (-500.0, None)], "x double, y double")
    assert {(r["rule"], r["value"]) for r in checks.degree_findings(far, [checks.Pair("x", "y", projection="mercator")]).collect()} == {("longitude", 181.0), ("latitude", -91.0), ("mercator", -91.0)}
    assert checks.coordinate_findings(df, []).count() == 0


def test_names_of_layouts_and_columns(spark):
    r = [roles.Role("categorical", ("A b",)), roles.Role("categorical", ("a-b",)), roles.Role("scatter", ("x", "y")), roles.Role("datetime", ("t",))]
    assert [n for n, _ in roles.layout_names(r)] == ["grid", "datetime", "categorical_a-b", "categorical_a-b-1", "scatter"]
    assert roles.reserved_names(["id", "meta_id", "k"], {"id", "filename"}) == {"id": "_meta_id"}
    assert roles.renamed_roles(r, {"x": "meta_x"})[2].columns == ("meta_x", "y")
    own = spark.createDataFrame([(1, "scatter", ["s", "s"], ["log"])], "entry int, kind string, columns array<string>, options array<string>")
    assert len({p["print"] for p in roles.prints(own).collect()}) == 2


def test_a_layout_can_be_plugged_in(spark):
    @roles.layout("line")
    def line(items, role):
        return items.select("id", (F.col("id") / 10).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))

    try:
        assert roles.MAKERS["line"](spark.range(3), None).count() == 3
    finally:
        del roles.MAKERS["line"]


def test_search_columns_and_titles(spark):
    df = spark.createDataFrame([(1, "f.jpg", "short", "https://x", ["t"])], "id long, filename string, odd string, link string, tags array<string>")
    assert search.search_columns(df, {}, ("link",)) == [("odd", "title"), ("filename", "filename"), ("id", "id")]
    assert search.search_columns(df, {"odd": ("freeform", "Provenance")}, ("link",)) == [("filename", "filename"), ("id", "id")]
    assert search.title_like("x", "Caption", None) and not search.title_like("notes", "", 3.0) and not search.title_like("x", "", None)
    with pytest.raises(ValueError):
        search.search_columns(df, {}, fields="some")


def test_ids_of_a_look_up(spark):
    assert [r["id"] for r in ids.by_ids(spark.range(9), "id", " 3,3,,7 ").orderBy("id").collect()] == [3, 7]
    for bad in ("", "1;2", "x", ",".join(map(str, range(251)))):
        with pytest.raises(ValueError):
            ids.by_ids(spark.range(9), "id", bad)


def test_position_tables(spark):
    cells = spark.range(5).select("id", F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    assert positions.position_table(cells, 5).schema["x"].dataType.simpleString() == "float"
    for bad, n in ((cells.filter("id != 2"), 5), (cells.filter("id != 2").union(cells.filter("id = 3")), 5), (cells, 6)):
        with pytest.raises(ValueError):
            positions.position_table(bad, n)
    assert positions.position_difference(cells, cells.withColumn("x", F.col("x") + 1e-9)).first()["same"]
    assert not positions.position_difference(cells, cells.filter("id < 4")).first()["same"]


def test_ticks(spark):
    t = ticks.interval_ticks(spark, 1577836800 + 5, 1609459200, 12, "month", 1).collect()
    assert [r["label"] for r in t] == [f"2020-{m:02}" for m in range(2, 13)] + ["2021-01"]
    assert [r["label"] for r in ticks.year_ticks(spark, -27454204800, 1577836800, 9).collect()] == [str(y) for y in range(1100, 2001, 100)]
    inside = ticks.axis_ticks(spark, 1577836800 + 60, 1577836800 + 120, 9, ("hour", 1))
    assert inside.count() == 0 or inside.first()["label"] == "2020"
    assert ticks.interval_ticks(spark, 0, 3600, 5, "minute", 15).count() == 5


def test_pages_and_profiles(spark):
    df = spark.createDataFrame([(2, "b", [1]), (1, "a" * 200, None)], "id long, s string, l array<int>")
    got = {r["name"]: (r["type"], r["sample"]) for r in profile.column_profile(df).collect()}
    assert got["id"] == ("bigint", "1") and len(got["s"][1]) == 160 and got["l"] == ("array<int>", None)
    assert profile.column_profile(df.limit(0)).filter("sample is null").count() == 3
    assert [(r["id"], r["total"]) for r in profile.page(df, "id", 1, 5).collect()] == [(2, 2)]
    with pytest.raises(ValueError):
        profile.page(df, "id", 0, 10_001)


def test_sources(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    with pa.OSFile(str(tmp_path / "one.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write(table)
    with pa.OSFile(str(tmp_path / "two.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write(table)
    assert tables.read_arrow(spark, str(tmp_path / "*.arrow"), "a long, b string").count() == 6
    cells = spark.createDataFrame([("g", 1, 0, 1, 5), ("g", 1, 1, 1, 6), ("g", 2, 0, 1, 7)], "layout_id string, z int, tx int, ty int, id long")
    tables.write_tiles(cells, str(tmp_path / "tiles"))
    assert [r["id"] for r in tables.read_tile(spark, str(tmp_path / "tiles"), "g", 1, 0, 1).collect()] == [5]
    (tmp_path / "m.csv").write_text('a,b\n1,"x ""y""\nz"\n,2\n')
    rows = tables.read_csv(spark, str(tmp_path / "m.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 'x "y"\nz'), (None, "2")]
    same = tables.fixture(spark, 50).collect()
    assert same == tables.fixture(spark, 50).repartition(3).orderBy("id").collect()


def test_selection_print_does_not_follow_order(spark):
    def fnv(text):
        h = 0x811C9DC5
        for c in text:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        return f"{h:08x}"

    f = spark.createDataFrame([("s", "b.jpg", 2), ("s", "a.jpg", 10)], "selection string, name string, size long")
    assert catalog.selection_print(f).first()["print"] == fnv("a.jpg 10\nb.jpg 2") == catalog.selection_print(f.orderBy("size")).first()["print"]


def test_declutter_equals_a_loop(spark):
    import random

    random.seed(5)
    chips = [(i, random.randint(1, 9), random.gauss(0.5, 0.02), random.gauss(0.5, 0.02)) for i in range(400)] + [(1000 + i, 1, 0.1 * i, 0.1) for i in range(8)]
    got = view.declutter(spark.createDataFrame(chips, "id long, n long, x double, y double"), 0.08, 6).collect()
    want = []
    for c in sorted(chips, key=lambda c: (-c[1], c[0])):
        if len(want) < 6 and all((c[2] - w[2]) ** 2 + (c[3] - w[3]) ** 2 >= 0.08**2 for w in want):
            want.append(c)
    assert [tuple(r) for r in got] == want and len(want) == 6


def test_evictions_and_level(spark):
    res = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 9)], "tile string, used long")
    assert [r["tile"] for r in view.evictions(res, spark.createDataFrame([("b",)], "tile string"), 2).collect()] == ["c", "a"]
    assert view.level_for(1000, 1, 512, 1, [0, 1, 2]) == 1 and view.level_for(99999, 1, 512, 1, [0, 1]) == 1


def test_labels_do_not_overlap(spark):
    import random

    random.seed(6)
    boxes = [(i, random.randint(1, 9), x, y, x + 0.2, y + 0.1) for i in range(300) for x, y in [(random.random(), random.random())]]
    got = view.declutter_boxes(spark.createDataFrame(boxes, "id long, n long, x0 double, y0 double, x1 double, y1 double"), 5).collect()
    want = []
    for b in sorted(boxes, key=lambda b: (-b[1], b[0])):
        if len(want) < 5 and all(b[2] >= w[4] or b[4] <= w[2] or b[3] >= w[5] or b[5] <= w[3] for w in want):
            want.append(b)
    assert [tuple(r) for r in got] == want


def test_progress_is_written_at_most_once_a_gap(spark):
    rows = [("j", "s", "running", t) for t in (0, 100, 900, 1000, 1500, 2100)] + [("j", "s", "done", 2150), ("j", "t", "running", 5)]
    e = spark.createDataFrame(rows, "job string, stage string, state string, ms long").withColumn("ts", F.timestamp_millis("ms")).withColumn("seq", F.col("ms"))
    assert {(r["job"], r["stage"]): r["kept"] for r in stream.flushes(e).collect()} == {("j", "s"): 4, ("j", "t"): 1}


def test_image_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("b.PNG", "a.jpg", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    found = tables.checked_images(tables.scan_images(spark, str(tmp_path)))
    assert [r["filename"] for r in found.collect()] == ["a.jpg", "b.PNG"]
    with pytest.raises(ValueError, match="a.jpg"):
        tables.checked_images(found.union(found.limit(1)))
    with pytest.raises(ValueError, match="no image"):
        tables.checked_images(found.limit(0))


def test_versions_and_missing_prints(spark):
    e = spark.createDataFrame([("a", "p", "1"), ("b", None, "1")], "layout_id string, print string, version string")
    assert {r["version"] for r in catalog.restamped(e, "2").collect()} == {"1"} and {r["version"] for r in catalog.restamped(e.filter("print is not null"), "2").collect()} == {"2"}
    baked = spark.createDataFrame([("g", None, None), ("x", "c", "old"), ("y", "c", None)], "layout_id string, column string, print string")
    got = {r["layout_id"]: (r["checkable"], r["stale_columns"]) for r in catalog.baked_staleness(baked, spark.createDataFrame([("c", "new")], "column string, print string")).collect()}
    assert got == {"g": (True, []), "x": (True, ["c"]), "y": (False, [])}


def test_stored_tables_can_be_cleared(spark):
    import os

    assert tables.stored(spark.range(3)).count() == 3
    home = tables._home(spark).removeprefix("file://")
    assert os.path.isdir(home)
    tables.clear(spark)
    assert not os.path.exists(home) and tables.stored(spark.range(3)).count() == 3


def test_medians_between_values_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 100)
    rounds = []
    find = ranks.F.count_if
    monkeypatch.setattr(ranks.F, "count_if", lambda c: (rounds.append(1), find(c))[1])
    def look(rows, **how):
        df = spark.createDataFrame([(float(v),) for v in rows], "v double").repartition(4)
        del rounds[:]
        got = ranks.ranked(df, {"v": 0.5}, **how)["v"]
        assert len(rounds) <= 40  # without an end before: the bracket of both middle values stayed
        s, n = sorted(rows), len(rows)
        assert got == ((s[n // 2],) * 2 if how else (s[(n - 1) // 2], s[n // 2]))

    look([25] * 1000 + [26] * 1000)
    look([25] * 1000 + [26] * 1000, upper=True)
    look([1] * 999 + [2] + [3] * 1000)
    look([1] * 900 + [*range(2, 202)] + [300] * 900)
    look([1] * 900 + [*range(2, 502)] + [900] * 900)
    look([i % 50 for i in range(5000)])
    look([7] * 3000)


def test_reading_dense_ids_moves_no_row(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table whose size is not known to be small
    try:
        got = ids.dense_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "k", n=1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert [tuple(r) for r in got.orderBy("id").collect()] == [(i, i) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ids, "SORTED", 50)
    got = ids.dense_ids(spark.range(1000).select((-F.col("id")).alias("k")), "k", n=1000)
    assert sorted(tuple(r) for r in got.collect()) == [(i - 999, i) for i in range(1000)]
    assert ids.by_range(spark.range(1000), "id", n=1000).rdd.getNumPartitions() == 20 == ids.by_hash(spark.range(1000), "id", n=1000).rdd.getNumPartitions()
