"""Exact order statistics without a global sort: a sketch brackets the ranks, a count proves the bracket, the rest is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Values that may meet in one place.
FEW = 50_000


#: How far a first bracket reaches beside the wanted share.
SLACK = 0.002


def looks(columns: dict[str, float]) -> list[Column]:
    """Aggregates that ranked() begins with: each column's count and a sketch around its share q. A caller may take them with its own in one pass."""
    sketch = lambda c, q: F.percentile_approx(c, [max(0.0, q - SLACK), min(1.0, q + SLACK)], 10_000)
    return [x for c, q in columns.items() for x in (F.count(c).alias(f"{c}_n"), sketch(c, q).alias(f"{c}_s"))]


def ranked(df: DataFrame, columns: dict[str, float], upper: bool = False, looked: Row | None = None) -> dict[str, tuple[float, float]]:
    """For each column's share q, the non-null values at places floor(q (n - 1)) and ceil(q (n - 1)) of n sorted ones; upper: floor(q n) for both.

    A sketch brackets the wanted places; a pass counts what lies below it, at its ends
    and between them.  A place at an end is found; a bracket that the count refutes is
    drawn wider, one that holds over FEW values between its ends is bracketed again
    without them.  So each round leaves out values, however many rows share one, and
    no task and no driver sorts a column.  looked: the row of looks(), if the caller
    has it.
    """
    looked = looked or df.agg(*looks(columns)).first()
    found: dict[str, tuple[float, float]] = {c: (None, None) for c in columns if not looked[f"{c}_n"]}  # type: ignore[misc]
    count = {c: looked[f"{c}_n"] for c in columns if c not in found}
    place = {c: (min(n - 1, int(columns[c] * n)),) * 2 if upper else (int(columns[c] * (n - 1)), -int(-columns[c] * (n - 1) // 1)) for c, n in count.items()}
    #: By column: the values of places found; the ends between which the others lie (None: all values), values up to the first and between; the bracket to be tried; how wide to draw the next.
    got: dict[str, dict[int, float]] = {c: {} for c in count}
    held, below, inside = dict.fromkeys(count), dict.fromkeys(count, 0), dict(count)
    tried = {c: tuple(looked[f"{c}_s"]) for c in count}
    slack = dict.fromkeys(count, SLACK)

    def within(c: str) -> Column:
        return F.col(c) if held[c] is None else F.when((F.col(c) > F.lit(held[c][0])) & (F.col(c) < F.lit(held[c][1])), F.col(c))

    while len(found) < len(columns):
        few = [c for c in count if c not in found and inside[c] <= FEW]
        many = [c for c in count if c not in found and inside[c] > FEW]
        open_ = {c: [p for p in place[c] if p not in got[c]] for c in (*few, *many)}
        if few:
            row = df.agg(*[F.sort_array(F.collect_list(within(c))).alias(c) for c in few]).first()
            for c in few:
                got[c] |= {p: row[c][p - below[c]] for p in open_[c]}
        drawn = [c for c in many if tried[c] is None]
        if drawn:
            ends = {c: [max(0.0, (open_[c][0] - below[c]) / inside[c] - slack[c]), min(1.0, (open_[c][-1] - below[c]) / inside[c] + slack[c])] for c in drawn}
            row = df.agg(*[F.percentile_approx(within(c), ends[c], 10_000).alias(c) for c in drawn]).first()
            tried |= {c: tuple(row[c]) for c in drawn}
        if many:
            tests = lambda c: (F.col(c) < F.lit(tried[c][0]), F.col(c) <= F.lit(tried[c][0]), F.col(c) < F.lit(tried[c][1]), F.col(c) <= F.lit(tried[c][1]))
            row = df.agg(*[F.count_if(test).alias(f"{c}_{i}") for c in many for i, test in enumerate(tests(c))]).first()
        for c in many:
            low, after, before, high = (row[f"{c}_{i}"] for i in range(4))
            if low <= open_[c][0] and open_[c][-1] < high:
                got[c] |= {p: tried[c][0] for p in open_[c] if p < after} | {p: tried[c][1] for p in open_[c] if p >= before}
                held[c], below[c], inside[c], slack[c] = tried[c], after, before - after, SLACK
            else:
                slack[c] *= 4
            tried[c] = None
        found |= {c: (got[c][place[c][0]], got[c][place[c][1]]) for c in open_ if all(p in got[c] for p in place[c])}
    return found


def medians(df: DataFrame, columns: list[str], looked: Row | None = None) -> list[float]:
    """Each column's median: the mean of the two middle values of an even number. looked: as ranked() takes it, for shares of 0.5."""
    found = ranked(df, dict.fromkeys(columns, 0.5), looked=looked)
    return [(found[c][0] + found[c][1]) / 2 if found[c][0] is not None else None for c in columns]  # type: ignore[misc]
