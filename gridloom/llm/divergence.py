"""How far sources differ in their words, by language: a heavy-light split with exact integer sums.

Every (lang, source) group gives each kept term of its language a smoothed share
p; two groups differ by the sum over all kept terms of floor((p - q)**2 / (p + q)).

A term that neither group holds adds the same to a pair whatever the term is, so
each pair starts with that value times all kept terms, and terms only add
corrections.  Light terms, held by few groups, correct by their postings: what a
posting adds against a group without the term depends on its count alone, so
like counts are taken together, and the few pairs inside one posting list are put
right after that.  Heavy terms, held by many groups, fill dense tiles of terms by
groups, one row of pairs at a time.  Both parts are whole numbers and add up
exactly, in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _text
from gridloom.llm._store import written

#: Term bytes: A-Z, a-z and all beyond ASCII.
_LETTER = np.ones(256, bool)
_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Bytes of text looked at together; texts longer than that are counted apart.
SLICE = 4 << 20


@dataclass(frozen=True)
class Audit:
    """least: documents of a language that a kept term is in; top: ranks of the terms; unit: of the shares;
    heavy: groups from which a term is heavy; postings: of a tile, about; block: groups whose pairs one task makes."""

    least: int = 10
    top: int = 10
    unit: int = 1_000_000_000
    heavy: int = 6
    postings: int = 1 << 18
    block: int = 256

    def __post_init__(self):
        if self.unit not in (1000, 1_000_000, 1_000_000_000):
            raise ValueError("shares count in thousands, millions or thousand millions")


def _same_as_before(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the one before it."""
    size = ends - starts
    same = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return same
    same[1:] = size[1:] == size[:-1]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        left = np.minimum(size[at] - k, 8)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
        differs = ((word[starts[at] + k] ^ word[starts[at - 1] + k]) & mask) != 0
        same[at[differs]] = False
        k += 8
        at = at[~differs & (size[at] > k)]
    return same


def _tally(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """group, occurrences, texts with it, and bytes of each term of each group in the rows."""
    starts, ends, rows = _text.runs(_LETTER[data], offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, []
    lower = _text.lower_ascii(data)
    hashed = _text.spans_hash(lower, starts, ends)
    order = np.argsort(hashed, kind="stable")  # of one hash, rows stay in order
    fresh = ~_same_as_before(lower, starts[order], ends[order])
    if int(fresh.sum()) != 1 + int((hashed[order][1:] != hashed[order][:-1]).sum()):  # two terms of one hash
        number: dict[bytes, int] = {}
        raw = lower.tobytes()
        term = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        order = np.argsort(term, kind="stable")
        fresh = np.concatenate(([True], term[order][1:] != term[order][:-1]))
    term = np.cumsum(fresh) - 1
    row = rows[order]
    first_in_row = fresh.copy()
    first_in_row[1:] |= row[1:] != row[:-1]
    some = np.flatnonzero(first_in_row)  # (term, text) pairs
    n = np.diff(np.append(some, len(order)))
    key = term[some] * (int(group.max()) + 1) + group[row[some]]
    by_key = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[by_key][1:] != key[by_key][:-1])))
    total, texts = np.add.reduceat(n[by_key], edge), np.diff(np.append(edge, len(by_key)))
    where = order[some[by_key[edge]]]
    raw = lower.tobytes()
    return group[rows[where]], total, texts, [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of pieces of about SLICE bytes that end before a byte that is no letter."""
    lo = 0
    while lo < len(data):
        hi = lo + SLICE
        while hi < len(data):
            other = np.flatnonzero(~_LETTER[data[hi : hi + 4096]])
            if len(other):
                hi += int(other[0])
                break
            hi += 4096
        yield lo, min(hi, len(data))
        lo = hi


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and texts with it; a row with term null and n 0 for every group.

    A text over SLICE bytes is read piece by piece, so that memory follows its distinct
    terms and not its size, and counts once a term.
    """
    docs = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(g, len(names)) for g in zip(lang, source, strict=True)], np.int64)
            known = list(names)
            yield rows(known, [None] * len(known), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64))
            for lo, hi, data, offsets in _text.slices(batch.column(2), SLICE):
                if len(data) > SLICE:
                    total: Counter = Counter()
                    for a, b in _pieces(data):
                        _, n, _, terms = _tally(data[a:b], np.array([0, b - a]), group[lo:hi])
                        total.update(dict(zip(terms, n.tolist(), strict=True)))
                    at, terms = np.repeat(group[lo], len(total)), list(total)
                    n, texts = np.fromiter(total.values(), np.int64, len(total)), np.ones(len(total), np.int64)
                else:
                    at, n, texts, terms = _tally(data, offsets, group[lo:hi])
                if len(terms):
                    yield rows([known[i] for i in at.tolist()], terms, n, texts)
        _text.release()

    def rows(groups: list[tuple[str, str]], terms: list, n: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        decoded = [t if t is None else t.decode() for t in terms]
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.array(decoded, pa.string()), pa.array(n), pa.array(texts)], names=["lang", "source", "term", "n", "docs"])

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, size: np.ndarray, unit: int = 1_000_000_000) -> np.ndarray:
    """1 + floor(unit (count + 2) / size), exact: three digits at a time, for sizes below 9 * 10**15."""
    rest, out, left = count.astype(np.int64) + 2, np.zeros(np.broadcast(count, size).shape, np.int64), unit
    while left > 1:
        out, rest, left = out * 1000 + rest * 1000 // size, rest * 1000 % size, left // 1000
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of shares up to a thousand million and one."""
    return (p - q) * (p - q) // (p + q)


def corrections(size: np.ndarray, mine: np.ndarray, term: np.ndarray, group: np.ndarray, n: np.ndarray, how: Audit) -> np.ndarray:
    """What the terms add to each pair (a group of `mine`, any group) beyond what terms that neither holds add.

    size: each group's divisor; term, group, n: postings in order of term.
    """
    none = shares(np.zeros(len(size), np.int64), size, how.unit)
    base = apart(none[mine][:, None], none[None, :])
    out = np.zeros_like(base)
    if not len(term):
        return out
    place = np.full(len(size), -1)
    place[mine] = np.arange(len(mine))
    edge = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    held = np.diff(np.append(edge, len(term)))
    p = shares(n, size[group], how.unit)
    heavy = np.repeat(held >= how.heavy, held)
    # heavy: tiles of about a million numbers
    wide = np.flatnonzero(held >= how.heavy)
    for lo in range(0, len(wide), step := max(1, (1 << 18) // len(size))):
        part = wide[lo : lo + step]
        tile = np.repeat(none[None, :], len(part), 0)
        for i, t in enumerate(part.tolist()):
            at = slice(edge[t], edge[t] + held[t])
            tile[i, group[at]] = p[at]
        for k, g in enumerate(mine.tolist()):
            out[k] += apart(tile[:, g][:, None], tile).sum(0) - len(part) * base[k]
    # light: each posting against groups without the term, like counts together
    g, c = group[~heavy], n[~heavy]
    if len(g):
        alike, times = np.unique(np.stack([g, c]), axis=1, return_counts=True)
        for lo in range(0, alike.shape[1], step := max(1, (1 << 20) // len(size))):
            a, m = alike[:, lo : lo + step], times[lo : lo + step]
            rise = (apart(shares(a[1], size[a[0]], how.unit)[:, None], none[None, :]) - apart(none[a[0]][:, None], none[None, :])) * m[:, None]
            own = place[a[0]]
            np.add.at(out, own[own >= 0], rise[own >= 0])  # against every other group
            per_group = np.zeros((len(size), len(mine)), np.int64)
            np.add.at(per_group, a[0], rise[:, mine])  # and every own group against it
            out += per_group.T
        # pairs that hold the term both: at most how.heavy - 1 apart in a posting list
        at = np.flatnonzero(~heavy)
        t, q = term[at], p[at]
        for d in range(1, how.heavy - 1 if how.heavy > 2 else 1):
            i = np.flatnonzero(t[:-d] == t[d:]) if d < len(t) else np.zeros(0, np.int64)
            x, y, u, v = g[i], g[i + d], q[i], q[i + d]
            both = apart(u, v) - apart(u, none[y]) - apart(none[x], v) + apart(none[x], none[y])
            for a, b in ((x, y), (y, x)):
                own = place[a] >= 0
                np.add.at(out, (place[a][own], b[own]), both[own])
    return out


def divergence(documents: DataFrame, how: Audit | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and by which terms from its language.

    part `pair`: item is each other source of the language.  part `term`: item is
    each of the how.top kept terms by which the group lies above its language's share
    the most.  Ranks go from 1 by falling value, ties by the item's bytes.  Null text,
    lang and source read as ''; a group without a kept term still has shares (of a
    language that keeps none, all pairs are 0).  Every row is a document of its own,
    repeats too; an empty table gives no rows; texts are read whole; other columns,
    doc_id among them, are not read.  The pairs of S sources are S * S rows by contract.
    """
    how = how or Audit()
    counted = written(term_counts(documents))
    groups = counted.filter("term is null").select("lang", "source")
    kept = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("held")).filter(F.col("docs") >= how.least)
    kept = written(kept.select("lang", "term", "all", "held"))  # a posting list is no longer than its language has sources
    per_group = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("N"))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("all").alias("lang_N"))
    groups = written(groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["N", "V", "lang_N"]))
    known = kept.agg(F.sum(F.size("held")).alias("n")).first()["n"] or 0
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tiles, blocks = max(1, -(-known // how.postings)), max(1, -(-most // how.block))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = kept.withColumn("tile", F.pmod(F.xxhash64("term"), F.lit(tiles)).cast("int")).withColumn("block", F.explode(every))
    right = groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("block", F.explode(every))

    def one(key: tuple, terms: pa.Table, group: pa.Table) -> pa.Table:
        lang, tile, block = (k.as_py() for k in key)
        group = group.sort_by("source")
        names = group.column("source").to_pylist()
        v = group.column("V")[0].as_py()
        lang_size = group.column("lang_N")[0].as_py() + 2 * v
        if block * how.block >= len(names) or (tile and not v):
            return table(lang, "pair", [], [], np.zeros(0, np.int64))
        size = np.maximum(group.column("N").to_numpy() + 2 * v, 1)  # without a kept term no share is asked for
        mine = np.arange(block * how.block, min(len(names), (block + 1) * how.block))
        number = {s: i for i, s in enumerate(names)}
        held = terms.column("held").combine_chunks()
        lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = held.flatten()
        who = np.array([number[s] for s in flat.field("source").to_pylist()], np.int64)
        n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((who, term))
        term, who, n = term[order], who[order], n[order]
        value = corrections(size, mine, term, who, n, how) if v else np.zeros((len(mine), len(names)), np.int64)
        if v and not tile:
            zero = shares(np.zeros(len(size), np.int64), size, how.unit)
            value += v * apart(zero[mine][:, None], zero[None, :])
        a, b = np.nonzero(np.ones_like(value, bool))
        other = mine[a] != b
        a, b = a[other], b[other]
        parts = [("pair", [names[i] for i in mine[a].tolist()], [names[i] for i in b.tolist()], value[a, b])]
        own = (who >= mine[0]) & (who <= mine[-1])
        term, who, n = term[own], who[own], n[own]
        if len(term):
            p = shares(n, size[who], how.unit)
            q = shares(terms.column("all").to_numpy().astype(np.int64)[term], np.full(len(term), lang_size), how.unit)
            above = np.flatnonzero(p > q)
            gain = apart(p[above], q[above])
            words = terms.column("term").to_pylist()
            best = np.lexsort((-gain, who[above]))
            above, gain = above[best], gain[best]
            start = np.flatnonzero(np.concatenate(([True], who[above][1:] != who[above][:-1]))) if len(above) else []
            for lo, hi in zip(start, np.append(start[1:], len(above)) if len(above) else [], strict=True):
                floor = gain[min(lo + how.top, hi) - 1]
                some = [(-int(x), words[term[i]].encode(), words[term[i]]) for i, x in zip(above[lo:hi].tolist(), gain[lo:hi].tolist(), strict=True) if x >= floor]
                some = sorted(some)[: how.top]
                parts.append(("term", [names[who[above[lo]]]] * len(some), [w for _, _, w in some], np.array([-x for x, _, _ in some], np.int64)))
        return pa.concat_tables([table(lang, *p) for p in parts])

    def table(lang: str, part: str, source: list[str], item: list[str], value: np.ndarray) -> pa.Table:
        return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array([part] * len(source), pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    made = left.groupBy("lang", "tile", "block").cogroup(right.groupBy("lang", "tile", "block")).applyInArrow(one, "lang string, source string, part string, item string, value long")
    made = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return made.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= how.top))
