"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document copy gets a virtual finish time: its source's cumulative size, in a
shuffled order, divided by the source's target.  All sources then reach their
targets at time 1, so one global order by finish time, cut at the total budget,
is the mix; any prefix of that order is mixed in the same proportions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._store import free, written
from gridloom.llm._text import WORD_PATTERN
from gridloom.operators.ids import dense_ids

#: Documents in one cell of a source's shuffled order, which bounds what one task sorts; cells of time in one round.
CELL, STEPS = 20_000, 4096


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target of each source of (source, source_size, n_docs).

    Sources take the weights in turn, by code point, null last.  They share
    budget * all sizes by weight; a target stops at most * its source's size, and
    the excess is shared again by weight until none is above.  That end state has
    target = min(most * size, level * weight) with one common level: with sources
    in order of size / weight, it is the first level that the next source's cap
    does not undercut.  One row per source stands in these windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("i"))
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(turn, (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("open"))
    # the level holds from the first source whose cap is above its share
    t = t.withColumn("met", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("i"), F.col("level")))).over(everything))
    level = F.col("met.level")
    target = F.when(F.col("met").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def finish_times(docs: DataFrame, targets: DataFrame, seed: int = 17, most: int = 2) -> DataFrame:
    """docs (row key, source, size) times `most` passes, with finish: the virtual finish time of that copy.

    A source's cumulative size is a sum of whole cells of its shuffled order plus
    a window inside one cell, so no task sorts a source; a hot source has more cells.
    """
    passes = docs.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    j = passes.join(targets, passes["source"].eqNullSafe(targets["t_source"]), "inner").drop("t_source")
    at = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(seed), "pass")).otherwise(F.xxhash64("doc_id", F.lit(seed), "pass"))
    n = F.ceil(F.col("n_docs") / F.lit(CELL))
    j = j.withColumn("at", at).withColumn("cell", F.pmod(F.shiftrightunsigned("at", 24), n))
    # a cell's rank is its number, the order inside it is the hash's: together one fixed shuffle of the source
    cells = j.groupBy("source", "pass", "cell").agg(F.sum("size").alias("cell_size"))
    order = Window.partitionBy("source").orderBy("pass", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("cell_size").over(order), F.lit(0))).select(F.col("source").alias("c_source"), F.col("pass").alias("c_pass"), F.col("cell").alias("c_cell"), "base")
    inside = Window.partitionBy("source", "pass", "cell").orderBy("at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("inside", F.sum("size").over(inside))
    j = j.join(cells, j["source"].eqNullSafe(cells["c_source"]) & (F.col("pass") == F.col("c_pass")) & (F.col("cell") == F.col("c_cell")))
    finish = F.when(F.col("target") > 0, (F.col("base") + F.col("inside")) / F.col("target")).otherwise(F.lit(2.0))
    return j.withColumn("finish", finish).drop("c_source", "c_pass", "c_cell", "inside", "base", "cell", "n_docs")


def _cut(copies: DataFrame, budget: float) -> tuple[float, int]:
    """(finish, at) of the last copy whose running total, in the global order, is within the budget.

    Time is cut into at most STEPS cells; the one in which the budget runs out is cut
    again until it holds about CELL copies or a single moment.  Only that cell is
    sorted by row, and what reaches the driver is one row a round.
    """
    low, high, base = 0.0, None, 0
    while True:
        here = F.col("finish") >= F.lit(low)
        if high is not None:
            here = here & (F.col("finish") < F.lit(high))
        part = copies.filter(here)
        s = part.agg(F.count(F.lit(1)).alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b"), F.sum("size").alias("s")).first()
        if not s["n"] or base + s["s"] <= budget:
            return float("inf"), 0  # only in the first round: a chosen cell exceeds the budget
        if s["n"] <= 2 * CELL or s["a"] == s["b"]:
            break
        steps = min(STEPS, s["n"] // CELL + 1)
        width = (s["b"] - s["a"]) / steps
        cell = F.least(F.lit(steps - 1), F.floor((F.col("finish") - F.lit(s["a"])) / F.lit(width)))
        ends = part.groupBy(cell.alias("cell")).agg(F.sum("size").alias("s"), F.min("finish").alias("first"))
        run = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most STEPS rows
        ends = ends.withColumn("run", F.sum("s").over(run) + F.lit(base)).withColumn("next", F.lead("first").over(Window.orderBy("cell")))
        hit = ends.filter(F.col("run") > F.lit(budget)).orderBy("cell").first()
        low, base = hit["first"], hit["run"] - hit["s"]
        high = hit["next"] if hit["next"] is not None else high
    last = part.withColumn("run", F.sum("size").over(Window.orderBy("finish", "at", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(base))
    row = last.filter(F.col("run") <= F.lit(budget)).orderBy(F.desc("finish"), F.desc("at")).select("finish", "at").first()
    return (row["finish"], row["at"]) if row else (low, -(1 << 63))


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, pass, finish, taken of every copy of every document.

    taken says whether the mix takes that copy; copies is `most` per document, so no
    document exceeds `most` times its size.  The mix itself is the taken copies
    sorted by finish.  Null texts have size 0 and are taken (they cost nothing)
    once their time is due; sources of size 0 have target 0 and give nothing.  An
    empty table gives no rows.  Rows that repeat a doc_id, or have a null one, are
    documents of their own; row is their key.  Copies of one finish time go by their
    shuffle hash, then size.  Texts are counted whole, however long; columns beside
    doc_id, source and text are not read.
    """
    return _mixed(written(documents.select("doc_id", "source", word_count().alias("size")).withColumn("row", F.monotonically_increasing_id())), weights, budget, most, seed)


def _mixed(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """mix_sources of (doc_id, source, size, row) rows that are written already."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(by_source, weights, budget, most).withColumnRenamed("source", "t_source")
    copies = written(finish_times(sized, targets, seed, most))
    total = copies.agg(F.sum("size")).first()[0] or 0
    finish, at = _cut(copies, budget * total / most)
    taken = (F.col("finish") < F.lit(finish)) | ((F.col("finish") == F.lit(finish)) & (F.col("at") <= F.lit(at)))
    return copies.withColumn("taken", taken & (F.col("target") > 0))


def mix_totals(documents: DataFrame, **knobs) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted): one row per document."""
    copies = mix_sources(documents, **knobs)
    per_row = copies.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    return per_row.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, ordered: bool = True, **knobs) -> DataFrame:
    """The taken documents with all their columns, one row per taken copy, in the mix's order of finish times.

    Without `ordered` they come in no order: for a table, which keeps none, and where
    placed() gives the order back.

    The documents are written once with a row key, by which the taken copies are
    joined back: rows that repeat a doc_id, or have a null one, are taken each alone.
    """
    size, row, finish = (free(documents.columns, n) for n in ("_size", "_row", "_finish"))
    keyed = written(documents.withColumn(size, word_count()).withColumn(row, F.monotonically_increasing_id()))
    sized = keyed.select("doc_id", "source", F.col(size).alias("size"), F.col(row).alias("row"))
    taken = _mixed(sized, **knobs).filter("taken").select(F.col("row").alias(row), F.col("finish").alias(finish))
    out = keyed.join(taken, row)
    return (out.orderBy(finish, "doc_id", row) if ordered else out).select(*documents.columns)


def placed(mixed: DataFrame, name: str = "position", seed: int = 17) -> DataFrame:
    """The rows of a mix with their places 0, 1, 2 … in the mix's order, as tables keep no order.

    What the mix took of each source is shuffled and served at the rate of its size, so
    that any prefix of the places holds the sources in the whole mix's proportions.
    Rows are placed one by one, alike or not; null texts and sources count as in the
    mix; an empty table gives no rows.  All columns come back, whatever their names.
    """
    row = free([*mixed.columns, name], "_row")
    keyed = written(mixed.withColumn(row, F.monotonically_increasing_id()))
    # without an id the shuffle goes by row: copies of one document do not stand together
    sized = written(keyed.select(F.lit(None).cast("long").alias("doc_id"), "source", word_count().alias("size"), F.col(row).alias("row")))
    rates = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rates = rates.select(F.col("source").alias("t_source"), "source_size", "n_docs", F.col("source_size").cast("double").alias("target"))
    order = dense_ids(finish_times(sized, rates, seed, 1).select("finish", "at", "row"), "finish", "at", "row", name=name)
    return keyed.join(order.select(F.col("row").alias(row), name), row).select(*mixed.columns, name)
