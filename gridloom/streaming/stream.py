"""Keyed state over events: limiters, sessions, progress, appends, as batch jobs; `keyed` has their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ids import ranks_within
from gridloom.sources.tables import stored


#: Events of a key from which it is busy: its windows are found by links, not by a fold.
BUSY = 100_000


def limiter_counts(events: DataFrame, key: str, ts: str, window_s: int, limit: int = 1, busy: int = BUSY) -> DataFrame:
    """key, windows, events, rejected; a window opens at its key's first event after the last one closed and lets `limit` events through.

    A fold over each key's sorted times whose state is five numbers.  Times are cut
    first at gaps of window_s or more, which always close a window, so that a fold
    covers one busy stretch of a key.  Keys of more than `busy` events take part in no
    window and no array: see busy_counts().  Both ways give the same counts.
    """
    us = window_s * 1_000_000
    e = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    if events.count() <= busy:  # so no key has more; a count reads no column
        return _folded(e, us, limit)
    many = [r["key"] for r in e.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > busy).orderBy(F.desc("n")).limit(KEYS + 1).collect()]
    if not many:
        return _folded(e, us, limit)
    if len(many) > KEYS:  # too many to name: they are looked up
        known = e.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > busy).select(F.col("key").alias("k"))
        is_busy = e.join(known, F.col("key").eqNullSafe(F.col("k")), "left_semi")
        rest = e.join(known, F.col("key").eqNullSafe(F.col("k")), "left_anti")
    else:
        test = F.coalesce(F.col("key").isin([k for k in many if k is not None]), F.lit(False)) | (F.col("key").isNull() & F.lit(None in many))
        is_busy, rest = e.filter(test), e.filter(~test)
    return _folded(rest, us, limit).unionByName(busy_counts(is_busy, us, limit))


#: Busy keys that a filter names.
KEYS = 200


def _folded(e: DataFrame, us: int, limit: int) -> DataFrame:
    """limiter_counts of (key, t) by a fold a stretch."""
    w = Window.partitionBy("key").orderBy("t")
    e = e.withColumn("cut", (F.col("t") - F.lag("t").over(w) >= F.lit(us)).cast("int"))
    e = e.withColumn("stretch", F.sum(F.coalesce("cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.groupBy("key", "stretch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    state = "named_struct('o', {o}, 'n', {n}, 'windows', {w}, 'rejected', {r})"
    begin, more = state.format(o="t", n="1L", w="a.windows + 1L", r=f"a.rejected + {int(limit < 1)}L"), state.format(o="a.o", n="a.n + 1L", w="a.windows", r=f"a.rejected + if(a.n + 1 > {limit}, 1L, 0L)")
    fold = f"aggregate(ts, {state.format(o='ts[0]', n='0L', w='1L', r='0L')}, (a, t) -> if(t - a.o < {us}L, {more}, {begin}))"
    done = runs.select("key", F.size("ts").alias("n"), F.expr(fold).alias("a"))
    return done.groupBy("key").agg(F.sum("a.windows").alias("windows"), F.sum("n").cast("long").alias("events"), F.sum("a.rejected").alias("rejected"))


def busy_counts(e: DataFrame, us: int, limit: int) -> DataFrame:
    """limiter_counts of (key, t) by links: a key's events may be any number, and no task holds them.

    Each event has a place in its key and a link to the first event a window later,
    whose place is the number of events before that time: both are ranks of a table
    that is dealt out by ranges.  The windows open at the events that the links reach
    from place 0; doubling the links' length each round finds them in a logarithmic
    number of joins on (key, place), each round stored.
    """
    named = stored(e.filter("t is not null").withColumn("g", F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit(""))))
    placed = stored(ranks_within(named.select("g", "t"), "g", "t", name="i"))
    marks = placed.select("g", "t", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("i")).unionByName(placed.select("g", (F.col("t") + us).alias("t"), F.lit(0).alias("kind"), "i"))
    # before a mark stand the events before its time, and the marks of the events before its own
    links = ranks_within(marks, "g", "t", "kind", "i", name="r").filter("kind = 0").select("g", "i", (F.col("r") - F.col("i")).alias("to"))
    n = named.groupBy("g").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n"))
    links = stored(links)
    jump = links
    reached = stored(n.select("g", F.lit(0).cast("long").alias("i")))
    while True:
        more = stored(reached.join(jump, ["g", "i"]).select("g", F.col("to").alias("i")).join(links.select("g", "i"), ["g", "i"], "left_semi").join(reached, ["g", "i"], "left_anti"))
        if more.isEmpty():
            break
        reached = stored(reached.unionByName(more))
        far = jump.select("g", F.col("i").alias("to"), F.col("to").alias("then"))
        jump = stored(jump.join(far, ["g", "to"]).select("g", "i", F.col("then").alias("to")))
    opened = reached.join(links, ["g", "i"]).groupBy("g").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.greatest(F.col("to") - F.col("i") - limit, F.lit(0))).alias("rejected"))
    return n.join(opened, "g").select("key", "windows", F.col("n").alias("events"), "rejected")


def limited(events: DataFrame, key: str, ts: str, limit: int = 10, window_s: int = 60) -> DataFrame:
    """key, windows, events, rejected: what a limit of `limit` a window lets through."""
    return limiter_counts(events, key, ts, window_s, limit)


def progress(events: DataFrame) -> DataFrame:
    """job, stage, done, total, state of (job, stage, seq, done, total, state): done never falls, the last total and state count."""
    return events.groupBy("job", "stage").agg(F.max("done").alias("done"), F.max_by("total", "seq").alias("total"), F.max_by("state", "seq").alias("state"))


def eta(stages: DataFrame) -> DataFrame:
    """job, eta of (job, stage, unit, total, done, seconds, state, ordinal): open work over the last finished rate of its unit; null where a unit has none."""
    rates = stages.filter("state = 'done' and seconds > 0").groupBy("job", "unit").agg(F.max_by(F.try_divide(F.col("done"), F.col("seconds")), "ordinal").alias("rate"))
    left = stages.filter("state != 'done'").join(rates, ["job", "unit"], "left").withColumn("s", F.try_divide(F.col("total") - F.col("done"), F.col("rate")))
    return left.groupBy("job").agg(F.when(F.count("s") == F.count(F.lit(1)), F.sum("s")).alias("eta"))


def job_eta(stages: DataFrame) -> DataFrame:
    """job, eta of (job, unit, total, done, seconds, state, ordinal) stages: what the running ones need at their own rate, and the waiting ones at the last finished rate of their unit.

    Null where a running stage has no rate yet, where none runs, and where a waiting one's unit has no rate.
    """
    own = F.try_divide(F.col("done"), F.when(F.col("seconds") > 0, F.col("seconds")))
    rates = stages.filter("state = 'done'").withColumn("r", own).filter("r is not null").groupBy("job", "unit").agg(F.max_by("r", "ordinal").alias("rate"))
    j = stages.filter("state in ('running', 'queued')").join(rates, ["job", "unit"], "left")
    need = F.when(F.col("state") == "running", F.try_divide(F.col("total") - F.col("done"), F.nullif(own, F.lit(0.0)))).otherwise(F.try_divide(F.col("total").cast("double"), F.nullif("rate", F.lit(0.0))))
    whole = (F.count("need") == F.count(F.lit(1))) & (F.count_if(F.col("state") == "running") > 0)
    return j.withColumn("need", need).groupBy("job").agg(F.when(whole, F.sum("need")).alias("eta"))


def closed(stages: DataFrame, failed: DataFrame) -> DataFrame:
    """progress()'s rows once jobs (job) have failed: what still ran there has failed too."""
    j = stages.join(failed.select("job").distinct().withColumn("_f", F.lit(True)), "job", "left")
    return j.withColumn("state", F.when(F.col("_f") & (F.col("state") == "running"), "failed").otherwise(F.col("state"))).drop("_f")


def flushes(events: DataFrame, gap_s: int = 1) -> DataFrame:
    """job, stage, kept: how many progress events (job, stage, state, ts, seq) are written: at most one every gap_s a stage, but for changes of state, which always are."""
    w = Window.partitionBy("job", "stage").orderBy("ts", "seq")
    e = events.withColumn("turn", F.coalesce(F.col("state") != F.lag("state").over(w), F.lit(True)).cast("int"))
    e = e.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("key", F.struct("job", "stage", "run"))
    return throttled(e, "key", "ts", gap_s).groupBy("key.job", "key.stage").agg(F.sum("kept").alias("kept"))


def sessions_to_reap(files: DataFrame, now: str, ttl_days: int = 7) -> DataFrame:
    """session, created, last of sessions whose last file is at least ttl_days old; finalised ones (any file with final) stay."""
    s = files.groupBy("session").agg(F.min("ts").alias("created"), F.max("ts").alias("last"), F.bool_or("final").alias("final"))
    return s.filter(~F.col("final") & (F.col("last") <= F.to_timestamp_ntz(F.lit(now)) - F.expr(f"interval {ttl_days} days"))).select("session", "created", "last")


def throttled(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """key, kept: events that pass a throttle of one per gap after the last one passed; the windows of limiter_counts open exactly there."""
    return limiter_counts(events, key, ts, gap_s).select("key", F.col("windows").alias("kept"))


def tumbling(events: DataFrame, ts: str, width: str, watermark: str | None = None) -> DataFrame:
    """Extension: start, type, n of fixed windows; works on streams with a watermark."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", watermark) if watermark else e
    return e.groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, ts: str, width: str, every: str) -> DataFrame:
    """Extension: start, n of overlapping windows."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), width, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def session_windows(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Extension: key, start, n of runs of events with gaps below `gap`."""
    s = F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")
    return events.groupBy(F.col(key).alias("key"), s).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def appended(chunks: DataFrame) -> DataFrame:
    """What becomes of files sent in chunks: session, name, staged, size, sha, refused, failed, already, conflicts.

    chunks: session, name, seq, offset, length, size, ok, sha.  A chunk must have
    0 <= offset < size.  Offset 0 drops what is staged and starts anew; another chunk
    counts only where the staged bytes end and for the same size, else it is refused.
    A chunk that failed (not ok) is cut off again.  One that brings more than the size
    drops the staged bytes.  A file that reaches its size is stored, unless its name
    is: then it is already present (same size and sha) or a conflict.  A row without
    offset sends a whole file, beside the staged one.

    A new start makes a run of its own, folded from its own chunks; runs that
    complete and whole files then meet by name, where the first is the stored one.
    """
    valid = (F.col("offset") >= 0) & (F.col("offset") < F.col("size"))
    order = Window.partitionBy("session", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    c = chunks.filter("offset is not null").withColumn("valid", F.coalesce(valid, F.lit(False)))
    c = c.withColumn("run", F.sum((F.col("valid") & (F.col("offset") == 0)).cast("int")).over(order))
    runs = c.groupBy("session", "name", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "offset", "length", "size", "ok", "sha", "valid"))).alias("c"))
    state = lambda staged, declared, refused="a.refused", failed="a.failed", done="a.done": f"named_struct('staged', {staged}, 'declared', {declared}, 'refused', {refused}, 'failed', {failed}, 'done', {done})"
    nothing, kind = "cast(null as bigint)", "cast(null as struct<seq:bigint,size:bigint,sha:string>)"
    fold = f"""aggregate(c, {state("0L", nothing, "0L", "0L", kind)}, (a, x) -> case
        when not x.valid or (x.offset > 0 and (x.offset != a.staged or not (x.size <=> a.declared))) then {state("a.staged", "a.declared", "a.refused + 1L")}
        when not x.ok then {state("x.offset", "x.size", failed="a.failed + 1L")}
        when x.offset + x.length > x.size then {state("0L", nothing, "a.refused + 1L")}
        when x.offset + x.length = x.size then {state("0L", nothing, done="named_struct('seq', cast(x.seq as bigint), 'size', x.size, 'sha', x.sha)")}
        else {state("x.offset + x.length", "x.size")} end)"""
    done = runs.select("session", "name", "run", F.expr(fold).alias("f"))
    whole = chunks.filter("offset is null")
    ends = done.filter("f.done is not null").select("session", "name", "f.done.*").unionByName(whole.filter("ok").select("session", "name", F.col("seq").cast("long").alias("seq"), "size", "sha"))
    # of like files one row, as the rest of them are already present
    ends = ends.groupBy("session", "name", "size", "sha").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    first = F.min_by(F.struct("size", "sha", "n"), "seq").alias("first")
    files = ends.groupBy("session", "name").agg(first, F.sum("n").alias("n"))
    files = files.select("session", "name", F.col("first.size").alias("size"), F.col("first.sha").alias("sha"), (F.col("first.n") - 1).alias("already"), (F.col("n") - F.col("first.n")).alias("conflicts"))
    staged = done.groupBy("session", "name").agg(F.max_by("f.staged", "run").alias("staged"), F.sum("f.refused").alias("refused"), F.sum("f.failed").alias("failed"))
    lost = whole.filter("not ok").groupBy("session", "name").agg(F.count(F.lit(1)).alias("lost"))
    names = chunks.select("session", "name").distinct()
    j = names.join(staged, ["session", "name"], "left").join(lost, ["session", "name"], "left").join(files, ["session", "name"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("session", "name", zero("staged"), "size", "sha", zero("refused"), (F.coalesce("failed", F.lit(0)) + F.coalesce("lost", F.lit(0))).cast("long").alias("failed"), zero("already"), zero("conflicts"))
