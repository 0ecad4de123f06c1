"""Quotation linking: from messages with nested quotes to reply-ordered conversations without them.

Lines are parsed into quote levels (leading '>' signs).  The neighbouring lines of
one level are a passage; case and white space are normalised and the passage is
hashed by runs of words, whatever its line breaks, beside its lines as such.  The
hashes are joined to the messages that first wrote them: in the same conversation
if one did so earlier, else in any other.  Each message's sources vote by lines.
All of it is DataFrame work: the joins are by hash against one row per hash,
pre-aggregated, so a common line or run is one row a task and no group of messages
meets itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._store import written

#: Leading quote signs, and lines that announce a quotation.
LEVEL = r"^[ \t]*(>[ \t]*)+"
ANNOUNCES = r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)[^:]{0,40}:\s*$"

#: Words in a hashed run of a passage; a passage of fewer words is one run.
RUN = 5


def parsed_lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, row, at, level, line, announces of each line of each message with text; level 0 is the message's own."""
    lines = messages.filter("text is not null").select("conv_id", "turn", "row", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    mark = F.regexp_extract("raw", LEVEL, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(mark, r"[ \t]", ""))).withColumn("line", F.trim(F.substring(F.col("raw"), F.length(mark) + 1, F.length("raw"))))
    return lines.withColumn("announces", (F.col("level") == 0) & F.regexp_like("line", F.lit(ANNOUNCES)))


def _hash():
    plain = F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))
    return F.xxhash64(plain, F.length(plain))


def own_text():
    """The text without quoted lines, and without announcing lines where it quotes: a column expression."""
    quotes = F.regexp_like("text", F.lit(f"(?m){LEVEL}"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.regexp_like(x, F.lit(LEVEL)) & ~(quotes & F.regexp_like(x, F.lit(ANNOUNCES))))
    return F.when(~quotes, F.col("text")).otherwise(F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")))


def _words(messages: DataFrame) -> DataFrame:
    """conv_id, turn, ws: the words of each message with text, in order, each with its line's number and quote level (-1 for announcing lines)."""
    raw = F.split("text", "\n")

    def line(x, at):
        mark = F.regexp_extract(x, LEVEL, 0)
        plain = F.trim(F.regexp_replace(F.lower(F.substring(x, F.length(mark) + 1, F.length(x))), r"\s+", " "))
        level = F.length(F.regexp_replace(mark, r"[ \t]", ""))
        level = F.when((level == 0) & F.regexp_like(F.trim(x), F.lit(ANNOUNCES)), -1).otherwise(level)
        return F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), at.alias("at"), level.alias("level")))

    return messages.filter("text is not null").select("conv_id", "turn", F.flatten(F.transform(raw, line)).alias("ws"))


def _runs(words: DataFrame, size: int, whole: bool) -> DataFrame:
    """conv_id, turn, level, lo, hi (first and last line), h of each run of `size` words within one passage; whole: only those that are a passage."""
    begins = F.when(F.size("ws") >= size, F.sequence(F.lit(0), F.size("ws") - size)).otherwise(F.array().cast("array<int>"))
    at = words.select("conv_id", "turn", "ws", F.explode(begins).alias("i"))
    level = lambda k: F.get(F.col("ws"), F.col("i") + k)["level"]
    same = F.lit(True)
    for k in range(1, size):
        same = same & (level(k) == level(0))
    if whole:
        same = same & ~level(-1).eqNullSafe(level(0)) & ~level(size).eqNullSafe(level(0))
    run = F.slice("ws", F.col("i") + 1, size)
    return at.filter(same).select("conv_id", "turn", level(0).alias("level"), run[0]["at"].alias("lo"), run[size - 1]["at"].alias("hi"), F.xxhash64(run["w"], F.lit(size)).alias("h"))


#: Tasks that the rows of one hash are dealt out to, as everyone may quote one line.
SALTS = 16


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows with _salt, a number below SALTS that spreads the rows of one hash."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def _for_all(hashes: DataFrame) -> DataFrame:
    """One row a hash, once for each _salt."""
    return hashes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _sources(quoted: DataFrame, first: DataFrame, abroad) -> DataFrame:
    """quoted's rows with src_conv, src_turn: the conversation's own first message of first (h, conv_id, src_turn), if earlier; else, where `abroad`, the first of the others."""
    own = quoted.join(first, ["conv_id", "h"], "left").withColumn("src_conv", F.when(F.col("src_turn") < F.col("turn"), F.col("conv_id")))
    # the two first conversations of a hash: one of them is another than the quoting one
    where = F.struct("conv_id", "src_turn")
    least = first.groupBy("h").agg(F.min(where).alias("one"))
    second = first.join(least, "h").filter(F.col("conv_id") != F.col("one.conv_id")).groupBy("h").agg(F.min(where).alias("two"))
    both = least.join(second, "h", "left")  # one row a hash
    lost = own.filter(F.col("src_conv").isNull() & abroad).drop("src_conv", "src_turn")
    other = _dealt(lost, "conv_id", "turn").join(_for_all(both), ["h", "_salt"]).withColumn("src", F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))).filter("src is not null")
    out = [*quoted.columns, "src_conv", "src_turn"]
    return own.filter("src_conv is not null").select(*out).unionByName(other.withColumn("src_conv", F.col("src.conv_id")).withColumn("src_turn", F.col("src.src_turn")).select(*out))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, src_conv, src_turn, n_lines: for each message and quote level, the message that most of its quoted lines come from.

    A quoted passage is looked up by its lines (equal to whole lines of the
    original) and by all its runs of RUN words, so that re-wrapped and partial quotes
    link; a passage of fewer words is one run, looked up in its own conversation
    only, as a few words stand anywhere.  The original of a line or run is the first
    message of the conversation that wrote it itself, if earlier than the quoting
    one; else the first (conv_id, turn) of the other conversations that did.  A
    source's votes are the quoted lines that its lines and runs touch.  Votes tie to
    the source of more whole lines, of more runs, to the conversation's own, then to
    the later turn.
    """
    marked = messages.filter(F.regexp_like("text", F.lit(f"(?m){LEVEL}")))
    lines = parsed_lines(messages).filter("line != ''").withColumn("h", _hash())
    words = _words(marked)
    by_line = lines.filter("level > 0").select("conv_id", "turn", "level", F.col("at").alias("lo"), F.col("at").alias("hi"), "h", F.lit(0).alias("size"))
    runs = [_runs(words, k, k < RUN).filter("level > 0").withColumn("size", F.lit(k)) for k in range(1, RUN + 1)]
    for more in runs:
        by_line = by_line.unionByName(more)
    quoted = written(by_line.distinct())
    sizes = [r["size"] for r in quoted.select("size").distinct().collect()]  # 0 to RUN
    wrote = lines.filter("level = 0 and not announces").select("h", F.lit(0).alias("size"), "conv_id", "turn")
    for k in sizes:
        if k > 0:
            wrote = wrote.unionByName(_runs(_words(messages), k, False).filter("level = 0").select("h", F.lit(k).alias("size"), "conv_id", "turn"))
    wanted = quoted.select("h").distinct()
    first = written(_dealt(wrote, "conv_id").join(_for_all(wanted), ["h", "_salt"], "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("src_turn")))
    votes = written(_sources(quoted, first, (F.col("size") == 0) | (F.col("size") == RUN)).withColumn("whole", (F.col("size") == 0).cast("int")))
    key = ["conv_id", "turn", "level", "src_conv", "src_turn"]
    units = votes.groupBy(key).agg(F.sum("whole").alias("n_whole"), F.count(F.lit(1)).alias("n_units"))
    # a run over several lines touches all lines between that hold words of its level
    touched = votes.select(*key, F.explode(F.sequence("lo", "hi")).alias("lo")).distinct()
    held = quoted.filter("size = 0").select("conv_id", "turn", "level", "lo").distinct()
    touched = touched.join(held, ["conv_id", "turn", "level", "lo"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    rank = F.struct("n_lines", "n_whole", "n_units", (F.col("src_conv") == F.col("conv_id")).alias("same"), "src_turn", "src_conv")
    best = touched.join(units, key).groupBy("conv_id", "turn", "level").agg(F.max(rank).alias("b"))
    return best.select("conv_id", "turn", "level", F.col("b.src_conv").alias("src_conv"), F.col("b.src_turn").alias("src_turn"), F.col("b.n_lines").alias("n_lines"))


def _threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of (conv_id, turn, reply_turn) links: pointers double each round until all reach a message without one."""
    at = written(parents.select("conv_id", "turn", F.col("reply_turn").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        on = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = at.join(on, ["conv_id", "root"], "left")
        moved = written(step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("went")))
        at = moved.drop("went")
        if moved.filter("went").isEmpty():
            return at


def conversations(messages: DataFrame) -> DataFrame:
    """Each message of (conv_id, turn, role, text) without its quotes, with what it replies to, in reply order.

    reply_conv, reply_turn: the source of its lowest linked quote level (null
    without one).  thread_turn: the message at which its chain of replies in its
    conversation ends (itself without one); depth: the chain's length; quotes: the
    sources by level.  Rows are sorted by conv_id, thread_turn, turn, so that
    replies follow what they answer, thread by thread.  Null texts stay null and empty
    ones empty; texts are read whole, however long; ties are as links() says; other
    columns are not read; an empty table gives no rows; rows that repeat a (conv_id, turn) share its links;
    rows with a null conv_id or turn are never linked.
    """
    messages = messages.select("conv_id", "turn", "role", "text").withColumn("row", F.lit(0))
    found = written(links(messages.filter("conv_id is not null and turn is not null")))
    entry = F.struct("level", "src_conv", "src_turn", "n_lines")
    per = found.groupBy("conv_id", "turn").agg(F.min(entry).alias("b"), F.sum("n_lines").alias("n_linked"), F.array_sort(F.collect_list(entry)).alias("quotes"))  # one entry a quote level
    per = per.select("conv_id", "turn", F.col("b.src_conv").alias("reply_conv"), F.col("b.src_turn").alias("reply_turn"), "n_linked", "quotes")
    inside = per.filter("reply_conv = conv_id").select("conv_id", "turn", "reply_turn")
    out = messages.drop("row").join(per, ["conv_id", "turn"], "left").join(_threads(inside), ["conv_id", "turn"], "left")
    is_quote = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(LEVEL)))
    out = out.withColumn("n_quoted", F.coalesce(F.size(is_quote), F.lit(0)).cast("long")).withColumn("text", own_text())
    out = out.select("conv_id", "turn", "role", "reply_conv", "reply_turn", F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "quotes", "text")
    return out.orderBy("conv_id", "thread_turn", "turn")
