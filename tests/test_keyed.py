"""Keyed state on streams against the batch folds, and busy keys against a loop."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import keyed, stream

START = dt.datetime(2024, 1, 1)


def times(n, seed, span=4000):
    rng = random.Random(seed)
    return sorted(START + dt.timedelta(seconds=rng.random() * span) for _ in range(n))


def looped(events, window_s, limit):
    """key -> windows, events, rejected by one pass over sorted times."""
    held = defaultdict(list)
    for k, t in events:
        held[k].append(t)
    out = {}
    for k, ts in held.items():
        opened, n, windows, rejected = None, 0, 0, 0
        for t in sorted(ts):
            if opened is None or (t - opened).total_seconds() >= window_s:
                opened, n, windows = t, 0, windows + 1
            n += 1
            rejected += n > limit
        out[k] = windows, len(ts), rejected
    return out


def in_files(spark, df, path, column, parts):
    """Files that a stream reads one a batch, in order of a column."""
    rows = df.orderBy(column).collect()
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, write, mode="append"):
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.mark.parametrize("expire", [True, False])
def test_limiter_stream_equals_the_fold_and_expires(spark, tmp_path, expire):
    # three keys fall silent in turn, so their windows end while the stream goes on
    events = [(k, t) for i, k in enumerate("abc") for t in times(60, i, 700 + 900 * i)] + [("d", t) for t in times(50, 9, 5000)] + [(None, t) for t in times(9, 8, 3000)]
    df = spark.createDataFrame(events, "k string, ts timestamp")
    source = in_files(spark, df, str(tmp_path / "in"), "ts", 6)
    out = []
    q = run(keyed.limiter_stream(source, "k", "ts", 3, 120, expire=expire), tmp_path, lambda b, n: out.extend(b.collect()))
    got = Counter((r["key"], r["allowed"]) for r in out)
    want = looped(events, 120, 3)
    assert len(out) == len(events)
    assert {k: (n, got[k, False]) for k, (_, n, _) in want.items()} == {k: (got[k, True] + got[k, False], rejected) for k, (_, _, rejected) in want.items()}
    assert {r["key"]: (r["windows"], r["events"], r["rejected"]) for r in stream.limited(df, "k", "ts", 3, 120).collect()} == want
    states = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert (states[-1] < 5) if expire else (states[-1] == 5)


def test_a_slow_replay_opens_the_same_windows(spark, tmp_path):
    events = [("a", START + dt.timedelta(seconds=s)) for s in (0, 10, 59, 60, 61, 119, 121, 500)]
    df = spark.createDataFrame(events, "k string, ts timestamp")
    found = []
    for parts in (1, 8):  # in one batch, and one event a batch
        out = []
        folder = tmp_path / str(parts)
        run(keyed.limiter_stream(in_files(spark, df, str(folder / "in"), "ts", parts), "k", "ts", 2, 60), folder, lambda b, n, out=out: out.extend(b.collect()))
        found.append(sorted((r["ts"], r["allowed"]) for r in out))
    assert found[0] == found[1] and [a for _, a in found[0]] == [True, True, False, True, True, False, True, True]


def test_busy_keys_take_no_array(spark):
    events = [("hot", t) for t in times(3000, 1, 90_000)] + [("hot", START)] * 40 + [("twin", t) for t in times(900, 2, 100)] + [(None, t) for t in times(700, 3, 9000)] + [("cold", t) for t in times(30, 4)] + [("cold", None), ("hot", None)]
    df = spark.createDataFrame(events, "k string, ts timestamp").repartition(5)
    for limit in (0, 1, 7):
        want = looped([e for e in events if e[1]], 600, limit)
        got = {r["key"]: (r["windows"], r["events"], r["rejected"]) for r in stream.limiter_counts(df.filter("ts is not null"), "k", "ts", 600, limit, busy=500).collect()}
        assert got == want
    assert {r["key"]: r["windows"] for r in stream.limiter_counts(df, "k", "ts", 600, 1, busy=500).collect()}["hot"] == want["hot"][0]


def test_many_busy_keys(spark, monkeypatch):
    monkeypatch.setattr(stream, "KEYS", 2)
    events = [(k, t) for k in "abcd" for t in times(80, ord(k), 3000)] + [(None, t) for t in times(80, 5, 3000)] + [("e", START)]
    df = spark.createDataFrame(events, "k string, ts timestamp")
    assert {r["key"]: (r["windows"], r["events"], r["rejected"]) for r in stream.limiter_counts(df, "k", "ts", 300, 2, busy=50).collect()} == looped(events, 300, 2)


def test_chunks_append_alike_in_stream_and_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        whole = rng.random() < 0.05
        rows.append((rng.randrange(3), f"f{rng.randrange(4)}", i, None if whole else rng.choice([0, 0, 10, 10, 20, 20, 30, -1]), rng.choice([10, 10, 10, 25]), rng.choice([30, 30, 30, 20]), rng.random() > 0.1, rng.choice("ab")))
    df = spark.createDataFrame(rows, "session int, name string, seq long, offset long, length long, size long, ok boolean, sha string")
    out = []
    run(keyed.append_stream(in_files(spark, df, str(tmp_path / "in"), "seq", 5)), tmp_path, lambda b, n: out.extend(b.collect()))
    said = defaultdict(Counter)
    for r in out:
        said[r["session"], r["name"]][r["outcome"]] += 1
    assert len(out) == 1500
    for r in stream.appended(df).collect():
        c = said[r["session"], r["name"]]
        assert (c["failed"], c["already present"], c["conflict"], c["stored"]) == (r["failed"], r["already"], r["conflicts"], int(r["size"] is not None))
        assert c["invalid"] + c["out of order"] + c["other size"] + c["too long"] == r["refused"]
    assert {"stored", "conflict", "already present", "failed", "too long", "other size", "out of order", "invalid"} <= set(Counter(r["outcome"] for r in out))


def test_a_failed_chunk_is_cut_off_and_sent_again(spark):
    def after(*chunks):
        df = spark.createDataFrame([(1, "f", i, *c) for i, c in enumerate(chunks)], "session int, name string, seq long, offset long, length long, size long, ok boolean, sha string")
        r = stream.appended(df).first()
        return r["staged"], r["size"], r["refused"], r["failed"], r["already"], r["conflicts"]

    assert after((0, 10, 30, True, ""), (10, 10, 30, False, "")) == (10, None, 0, 1, 0, 0)
    assert after((0, 10, 30, True, ""), (10, 10, 30, False, ""), (10, 20, 30, True, "h")) == (0, 30, 0, 1, 0, 0)
    assert after((0, 30, 30, True, "h"), (None, 0, 30, True, "h"), (None, 0, 30, True, "g"), (0, 30, 30, True, "h")) == (0, 30, 0, 0, 2, 1)
    assert after((0, 10, 30, True, ""), (0, 10, 20, True, ""), (10, 10, 30, True, ""), (10, 10, 20, True, "h")) == (0, 20, 1, 0, 0, 0)
    assert after((0, 10, 30, True, ""), (10, 25, 30, True, ""), (10, 10, 30, True, "")) == (0, None, 2, 0, 0, 0)


def test_progress_never_falls_on_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"j{i % 3}", f"s{i % 2}", i, rng.randrange(100), 100 + i, "done" if i > 80 else "running") for i in range(90)]
    df = spark.createDataFrame(rows, "job string, stage string, seq long, done long, total long, state string")
    seen = defaultdict(list)
    run(keyed.progress_stream(in_files(spark, df, str(tmp_path / "in"), "seq", 5)), tmp_path, lambda b, n: [seen[r["job"], r["stage"]].append(r) for r in b.collect()], "update")
    assert all([r["done"] for r in v] == sorted(r["done"] for r in v) for v in seen.values())
    assert {k: tuple(v[-1]) for k, v in seen.items()} == {(r["job"], r["stage"]): tuple(r) for r in stream.progress(df).collect()}


def test_a_tally_stays_right_when_batches_come_again(spark, tmp_path):
    rng = random.Random(8)
    df = spark.createDataFrame([(f"u{rng.randrange(5)}", rng.randrange(1000), i) for i in range(300)], "upload string, bytes long, seq long")
    path, write = str(tmp_path / "tally"), keyed.write_tally(str(tmp_path / "tally"))

    def twice(batch, number):
        write(batch, number)
        write(batch, number)  # the batch comes again after a failure between write and commit

    run(keyed.tally_stream(in_files(spark, df, str(tmp_path / "in"), "seq", 4)), tmp_path, twice, "update")
    recount = df.groupBy("upload").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    assert sorted(map(tuple, keyed.read_tally(spark, path).select("upload", "n", "bytes").collect())) == sorted(map(tuple, recount.collect()))
