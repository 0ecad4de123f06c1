"""Declared columns, role changes, stale knobs, refresh verdicts, readable figures and ticks against plain versions."""

import datetime as dt
import json
import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import catalog, checks, positions, roles, ticks
from gridloom.plans.queries import QUERIES


def named(x):
    if isinstance(x, list):
        return set().union(*map(named, x)) if x else set()
    if not isinstance(x, dict):
        return set()
    out = set()
    for k, v in x.items():
        out |= {v} if (k == "column" or k.endswith("_column")) and isinstance(v, str) else named(v)
    return out


def test_columns_named_at_any_depth(spark):
    docs = [
        {"column": 'x"y', "roles": [{"a_column": "q\\", "b_column": None, "columns": "no"}, [[{"column": "deep"}]]]},
        {"note": '"column": "no"', "column": ["x", {"column": "in list"}], "Column": "no", "my_column": {"column": {"z_column": "far"}}},
        [{"column": "é😀"}, {"column": "é😀"}], "column", 7, {}, [], {"column": 5, "x_column": True, "y_column": ""},
    ]
    texts = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(docs)] + [(90, None), (91, "{broken"), (92, "")]
    got = {r["k"]: r["columns"] for r in roles.declared_columns(spark.createDataFrame(texts, "k long, j string"), "k", "j").collect()}
    want = {i: sorted(named(d)) for i, d in enumerate(docs)} | {90: [], 91: [], 92: []}
    assert got == want and want[0] == ["deep", "q\\", 'x"y']


def changes_by_hand(was, now):
    """The rule told in words: entries (entry, kind, columns, options)."""

    def readings(entries):
        out = defaultdict(set)
        for _, kind, columns, options in entries:
            for i, c in enumerate(columns):
                out[c].add((kind, (("first", "second")[i], columns[1 - i]) if kind in roles.PAIRS else (), tuple(options)))
        return out

    def pairs(entries):
        out = defaultdict(dict)
        for _, kind, columns, options in entries:
            if kind in roles.PAIRS:
                out[kind][tuple(columns), tuple(options)] = columns
        return out

    a, b, pa_, pb = readings(was), readings(now), pairs(was), pairs(now)
    changed = [c for c in {*a, *b} if a[c] != b[c]]
    if not changed:
        return 0
    n, axes = 0, set()
    for kind in roles.PAIRS:
        left, came = [k for k in pa_[kind] if k not in pb[kind]], [k for k in pb[kind] if k not in pa_[kind]]
        n += max(len(left), len(came))
        axes |= {c for k in left for c in pa_[kind][k]} | {c for k in came for c in pb[kind][k]}
    now_axes = {c for _, kind, columns, _ in now if kind in roles.PAIRS for c in columns}
    for c in changed:
        if c not in axes:
            n += 1
            continue
        had, has = ({r for r in x[c] if r[0] not in roles.PAIRS} for x in (a, b))
        n += bool(has - had) or any(not (r[0] == "freeform" and c in now_axes) for r in had - has)
    return n


def test_role_changes_count_edits(spark):
    rng = random.Random(11)
    kind = lambda: rng.choice(["scatter", "geographic", "categorical", "freeform", "tag"])

    def entry(i):
        k = kind()
        return (i, k, rng.sample("abcd", 2) if k in roles.PAIRS else [rng.choice("abcd")], [rng.choice(["", "log"])] if k != "freeform" else [])

    sides, want = ([], []), {}
    for d in range(120):
        was = [entry(i) for i in range(rng.randrange(5))]
        now = [e for e in was if rng.random() < 0.7] + [entry(10 + i) for i in range(rng.randrange(3))]
        if d % 10 == 0:
            now = list(reversed(was))
        n = changes_by_hand(was, now)
        if n:
            want[d] = n
        for side, entries in zip(sides, (was, now), strict=True):
            side.extend((d, f"{d}/{i}", *e) for i, *e in entries)

    def frame(rows):
        e = spark.createDataFrame(rows, "dataset long, entry string, kind string, columns array<string>, options array<string>")
        return roles.prints(e).join(e.select("dataset", "entry", "kind"), "entry").select("dataset", "entry", "kind", "column", "print")

    got = {r["dataset"]: r["n"] for r in roles.role_changes(frame(sides[0]), frame(sides[1])).collect()}
    assert got == want and len(want) > 60


def test_stale_knobs_are_refused(spark):
    rng = random.Random(12)
    committed = [(d, i, f"l{d}-{i}", rng.choice("pq"), rng.choice(["u", "v", None])) for d in range(150) for i in range(rng.randrange(4))]
    override = [(d, i, rng.choice("pqr"), rng.choice(["u", "v", None])) for d in range(150) for i in range(rng.randrange(4))]
    kept = [(d, layout) for d, _, layout, _, _ in committed if rng.random() < 0.8]
    printed = [(d, layout) for d, _, layout, _, _ in committed if rng.random() < 0.3]
    want = set()
    for d in range(150):
        last = {}
        for e, i, layout, pair, knobs in committed:
            if e == d and (d, layout) in kept:
                last[pair] = knobs, (last.get(pair, (None, None))[1] if (d, layout) in printed else layout)
        for e, i, pair, knobs in override:
            if e == d and last.get(pair, (0, None))[1] and knobs != last[pair][0]:
                want.add((d, pair, last[pair][1], sum(c[0] == d and c[3] == pair for c in committed) == 1 == sum(o[0] == d and o[2] == pair for o in override)))
                break
    layouts_ = "dataset long, layout_id string"
    got = roles.stale_knobs(spark.createDataFrame(committed, "dataset long, seq long, layout_id string, pair string, knobs string"), spark.createDataFrame(override, "dataset long, seq long, pair string, knobs string"), spark.createDataFrame(kept, layouts_), spark.createDataFrame(printed, layouts_))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20 and {w[3] for w in want} == {True, False}


def test_refresh_verdicts(spark):
    cells = [(name, i, 0.1 + 0.2 * i, 0.3 + 0.1 * i, 0.05, 0.05) for name in ("same", "newer", "current", "lost", "moved", "unchecked", "short", "other", "off") for i in range(3)]
    boxes = [(n, 0.075, 0.275, 0.525, 0.525) for n in dict.fromkeys(c[0] for c in cells)]
    version = {"newer": "2.11", "current": "2.10"}
    committed = [(b[0], version.get(b[0], "2.9"), 3, *(v + 2e-6 * (b[0] == "moved") for v in b[1:])) for b in boxes]
    baked = [c for c in cells if c[0] != "unchecked" and not (c[0] == "short" and c[1] == 2)]
    baked = [(n, i + 5 * (n == "other" and i == 2), x + 1e-4 * (n == "off" and i == 1), y, w, h) for n, i, x, y, w, h in baked]
    shape = "layout_id string, id long, x double, y double, w double, h double"
    got = positions.refresh_verdicts(
        spark.createDataFrame(committed, "layout_id string, version string, n long, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame([b for b in boxes if b[0] != "lost"], "layout_id string, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(baked, shape).select("layout_id", "id", *[F.col(c).cast("float").alias(c) for c in "xywh"]), spark.createDataFrame(cells, shape), "2.10",
    )
    assert {r["layout_id"]: r["verdict"] for r in got.collect()} == {"same": "same", "newer": "newer", "current": "current", "lost": "lost", "moved": "moved", "unchecked": "unchecked", "short": "shrunk", "other": "shrunk", "off": "diverged"}


def test_readable_sizes_and_times(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1280: "1.3 KiB", 102_348: "99.9 KiB", 102_400: "100 KiB", 1 << 20: "1.0 MiB", 310 << 30: "310 GiB", 5 << 40: "5.0 TiB", 3000 << 40: "3000 TiB"}
    took = {-3.0: "0 s", 0.4: "0 s", 44.6: "45 s", 59.5: "1 min", 89.0: "1 min", 90.0: "2 min", 3569.0: "59 min", 3570.0: "1 h", 11400.0: "3 h 10 min", 7200.0: "2 h"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in sizes], "v long").select("v", C.bytes_text(F.col("v"))).collect()} == sizes
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in took], "v double").select("v", C.duration_text(F.col("v"))).collect()} == took


def test_prints_of_selections_count_utf16_units(spark):
    def by_hand(files):
        h = 0x811C9DC5
        lines = sorted((f"{n.replace(chr(92), '/').rsplit('/', 1)[-1]} {s}" for n, s in files), key=lambda x: x.encode("utf-16-be"))
        raw = "\n".join(lines).encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    files = [("a/b/é.jpg", 3), ("x\\😀.png", 9), ("￮.png", 1), ("plain", 0)]
    df = spark.createDataFrame([("s", n, s) for n, s in files] + [("t", "one", 1)], "selection string, name string, size long")
    assert {r[0]: r[1] for r in catalog.selection_print(df).collect()} == {"s": by_hand(files), "t": by_hand([("one", 1)])}


def test_a_selection_of_many_lines_is_printed_in_one_pass(spark):
    files = [(f"f{i % 977}é￮.png", i) for i in range(20_000)]
    h = 0x811C9DC5
    raw = "\n".join(sorted(f"{n} {s}" for n, s in files)).encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    rows = [("s", n, s) for n, s in files] + [(None, "one", 1), (None, None, None)]
    df = spark.createDataFrame(rows, "selection string, name string, size long").repartition(7)
    began = time.monotonic()
    got = catalog.selection_print(df).collect()
    assert time.monotonic() - began < 30  # a place looked up in the whole text for each unit takes minutes
    nulls = catalog._fnv(0x811C9DC5, np.frombuffer("\none 1".encode("utf-16-be"), ">u2"))
    assert {r[0]: r[1] for r in got} == {"s": f"{h:08x}", None: f"{nulls:08x}"}


def test_sizes_beyond_64_bits(spark, tmp_path):
    keys = [0, 11, 20_000, 570_000, 1_200_000]
    spark.createDataFrame([(k, 50) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["id"]: r["size"] for r in QUERIES["readable_figures"](spark, str(tmp_path)).collect()}
    assert got == {0: "0 B", 11: "65.0 KiB", 20_000: "364 TiB", 570_000: f"{round(570_000**3 * 50 / 2**40)} TiB", 1_200_000: f"{round(1_200_000**3 * 50 / 2**40)} TiB"}


def test_ticks_are_bins_at_the_nearest_stride(spark):
    assert ticks.uniform("hour", 6) and ticks.uniform("year", 250) and not any(ticks.uniform(*r) for r in (("hour", 5), ("day", 2), ("minute", 7), ("week", 1), ("year", 0)))
    assert ticks.interval_ticks(spark, 0, 86400, 5, "hour", 5).count() == 0
    years = [r["label"] for r in ticks.axis_ticks(spark, 0, 86400 * 3000, 5, ("hour", 5)).collect()]
    assert years == ["1970", "1972", "1974", "1976", "1978"]  # uneven bins: years instead
    second = lambda d: int((d - dt.datetime(1970, 1, 1)).total_seconds())
    for (kind, step), low, high, wanted in ((("hour", 3), dt.datetime(2021, 3, 1, 1), dt.datetime(2021, 3, 9), 8), (("day", 1), dt.datetime(2020, 2, 20, 5), dt.datetime(2020, 6, 1), 6), (("minute", 15), dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 1, 9), 5), (("second", 5), dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 1, 0, 3), 4)):
        size = ticks.SECONDS[kind] * step
        bins = [b for b in range(second(low) // size, second(high) // size + 1) if second(low) <= b * size <= second(high)]
        cycle = ticks.CYCLE.get(kind, step)
        strides = sorted({step} | {d for d in range(step, cycle + 1, step) if cycle % d == 0} | {k * cycle * 10**p for p in range(6) for k in (1, 2, 5) if k * cycle * 10**p % step == 0})
        best = min(strides, key=lambda m: (abs(math.log(((bins[-1] - bins[0]) * step // m + 1) / wanted)), m))
        got = [r["t"] for r in ticks.interval_ticks(spark, second(low), second(high), wanted, kind, step).collect()]
        assert got == [b * size for b in bins if b % (best // step) == 0]


def test_stored_times_have_no_other_form(spark):
    df = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' as t, 'x' as s")
    got = {(r["column"], r["finding"]) for r in checks.role_findings(df, [("datetime", "t"), ("datetime", "t", "iso8601"), ("datetime", "t", "unix_millis"), ("datetime", "s", "unix_millis")]).collect()}
    assert got == {("t", "iso8601"), ("s", "timestamp")}


@pytest.mark.parametrize("declared, served, sidecar, want", [(["a", "b"], ["b"], True, (["a"], False)), ([], [], True, ([], True)), (None, None, None, ([], False)), (["a"], ["a"], False, ([], False))])
def test_tag_sidecars(spark, declared, served, sidecar, want):
    df = spark.createDataFrame([(1, declared, served, sidecar)], "dataset int, declared array<string>, served array<string>, sidecar boolean")
    assert catalog.tag_sidecars(df).first()[1:] == want
