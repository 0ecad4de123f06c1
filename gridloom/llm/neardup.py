"""Near-duplicate documents by DartMinHash signatures of word shingles.

Each shingle throws darts: a Poisson process of (height, time) points, hashed
from the shingle alone, of which those below the shingle's weight count.  Heights
are cut into the dyadic slabs [0,1), [1,2), [2,4) …, so a weight only meets the
slabs it reaches.  A dart falls on one of k coordinates; a signature keeps the
earliest dart of each.  Two documents keep the same dart on a coordinate with
probability equal to their weighted Jaccard similarity.  All documents need about
k ln k + 2k darts, however long they are: times are cut at that number divided
by the document's weight, and the cut is doubled where a coordinate stays empty.

Bands of the signature join candidates; each candidate link is then checked
exactly, and the linked documents' connected components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text
from gridloom.llm._store import free, written

_U = np.uint64
#: 64-bit words of a shingle set's bitmap.
MARKS = 16
#: Parts that the rows of one key are dealt to, one bit of a long each; members of a bucket that one task compares with the whole bucket.
PARTS, WIDE = 64, 2048


@dataclass(frozen=True)
class Near:
    """words: shingle length; similarity: least Jaccard similarity of a link;
    bands * rows coordinates a signature: a link at 0.8 is missed with
    probability (1 - 0.8**rows)**bands, 5e-5 here, and less above 0.8.
    counted: weigh a shingle by its occurrences, so that similarity is that of multisets; else by 1."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5
    counted: bool = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of occurrences of each text's distinct shingles, in row order.

    A text of fewer words has one shingle of all its words; a text without words none.
    """
    starts, ends, rows = _text.words(data, offsets)
    hashes = _text.spans_hash(data, starts, ends)
    n = len(offsets) - 1
    shingle, at = _text.shingles(hashes, rows, size)
    row = rows[at]
    n_words = _text.counts(rows, n)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), _U)
        for k in range(size - 1):
            more = n_words[short] > k
            extra[more] = _text.mix(extra[more] * _U(31) + hashes[np.minimum(first[more] + k, len(hashes) - 1)])
        row, shingle = np.concatenate((row, short)), np.concatenate((shingle, extra))
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1]))) if len(row) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    return row[edge], shingle[edge], np.diff(np.append(edge, len(row)))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """n * k earliest dart times (as bits; all bits set where a row has no weight)."""
    best = np.full(n * k, np.inf)
    mass = np.bincount(rows, weights, n)
    darts = k * math.log(k) + 2 * k
    until = np.divide(darts, mass, out=np.zeros(n), where=mass > 0)
    todo = mass > 0
    while todo.any():
        live = todo[rows]
        slab, low = 0, 0.0
        while live.any():
            high = 1.0 if slab == 0 else 2.0 * low
            row, element, weight = rows[live], elements[live], weights[live]
            seed = _text.mix(element + _U(slab * 0xA24BAED4963EE407 % 2**64))
            time, turn = np.zeros(len(row)), 0
            while len(row):
                turn += 1
                h = _text.mix(seed + _U(turn * 0x9FB21C651E98DF25 % 2**64))
                time = time - np.log(_unit(h)) / (high - low)
                on = time < until[row]
                row, seed, weight, time, h = row[on], seed[on], weight[on], time[on], h[on]
                g = _text.mix(h)
                hit = low + _unit(g) * (high - low) <= weight if (weight < high).any() else slice(None)
                np.minimum.at(best, row[hit] * k + (g[hit] >> _U(3)).astype(np.int64) % k, time[hit])
            low, slab = high, slab + 1
            live = live & (weights > low)
        todo = todo & np.isinf(best.reshape(n, k)).any(axis=1)
        until = np.where(todo, until * 2, until)
    return best.view(_U).reshape(n, k)


def _elements(data: np.ndarray, offsets: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row and hash of each set element (if counted, one an occurrence, its number mixed in); and each distinct shingle's row, hash and weight."""
    row, element, count = shingle_sets(data, offsets, near.words)
    if not near.counted:
        return row, element, (row, element, np.ones(len(count)))
    turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(row, count), _text.mix(np.repeat(element, count) + turn.astype(_U)), (row, element, count.astype(float))


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list column of a two-dimensional array's rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def prints(documents: DataFrame, near: Near) -> DataFrame:
    """doc_id, bands (64-bit hashes of band number and coordinates), n (size of the shingle set) and marks (its bitmap) of each document with a word."""
    k = near.bands * near.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.slices(batch.column(1)):
                row, element, weighted = _elements(data, offsets, near)
                some = np.unique(row)
                sig = signatures(*weighted, hi - lo, k)[some].reshape(len(some), near.bands, near.rows)
                band = np.tile(np.arange(near.bands, dtype=_U), (len(some), 1))
                for i in range(near.rows):
                    band = _text.mix(band * _U(0x9E3779B97F4A7C15) + sig[:, :, i])
                marks = np.zeros((hi - lo, MARKS), _U)
                np.bitwise_or.at(marks, (row, (element >> _U(6)).astype(np.int64) % MARKS), _U(1) << (element & _U(63)))
                n = np.bincount(row, minlength=hi - lo)[some]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, _lists(band), pa.array(n.astype(np.int64)), _lists(marks[some])], names=["doc_id", "bands", "n", "marks"])
        _text.release()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, bands array<long>, n long, marks array<long>")


def _sets(documents: DataFrame, near: Near) -> DataFrame:
    """doc_id and the sorted shingle hashes (with occurrence numbers mixed in, if counted) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.slices(batch.column(1)):
                row, element, _ = _elements(data, offsets, near)
                places = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(places), pa.array(element.view(np.int64)))], names=["doc_id", "shingles"])
        _text.release()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _linked(pairs: DataFrame, documents: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold.

    Only the texts on pairs are read for it.  Their ids are written first, so that
    Spark knows their size: it broadcasts them below its threshold and deals texts
    and ids by doc_id beyond.
    """
    pairs = written(pairs)
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = written(_sets(documents.join(ids, "doc_id", "left_semi"), near))
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("common") >= F.lit(near.similarity - 1e-12) * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _close(pairs: DataFrame, marks: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to be links."""
    left = marks.select(F.col("doc_id").alias("a"), "n", F.col("marks").alias("p"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("marks").alias("q"))
    return pairs.join(left, "a").join(right, "b").filter(_may_link(near)).select("a", "b")


def _may_link(near: Near):
    """Whether sets of n and m shingles with bitmaps p and q can be similar enough, as a column: never false for a link.

    Each bit in which the bitmaps differ is a shingle of only one set, and a link
    has at most (n + m) * (1 - s) / (1 + s) of those.
    """
    apart = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(1, MARKS)), F.bit_count(F.col("p")[0].bitwiseXOR(F.col("q")[0])))
    alike = F.least("n", "m") >= F.lit(near.similarity - 1e-12) * F.greatest("n", "m")
    return alike & (apart <= F.lit((1 - near.similarity) / (1 + near.similarity) + 1e-12) * (F.col("n") + F.col("m")))


def _with(rows: DataFrame, key: str, by: str, keep: str = "true", how: str = "left", values: DataFrame | None = None, **found: Column) -> DataFrame:
    """rows with their key's aggregates `found` or, given values (key, ... once a key), with those columns; only of keys that pass `keep`.

    A key may hold a third of all rows.  So its rows are dealt to PARTS parts by the
    hash of `by`: they are aggregated before they move, and what is found comes back
    to each part that has rows of the key, so at most once a row.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_part"))
    whole = dealt.filter(F.col(key).isNotNull()).groupBy(key).agg(*[v.alias(k) for k, v in found.items()], F.bit_or(bit).alias("_parts"))
    names = list(found)
    if values is not None:
        whole, names = whole.join(values, key), [c for c in values.columns if c != key]
    parts = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.call_function("getbit", F.col("_parts"), i) == 1)
    back = whole.filter(keep).select(key, *names, F.explode(parts).alias("_part"))
    return dealt.join(back, [key, "_part"], how).drop("_part")


def components(links: DataFrame) -> DataFrame:
    """doc_id, class_id (the least id of its component) of all ids on links (a, b).

    Alternates hooking each node's neighbours, then the node, to the least id next
    to it, until nothing moves: a logarithmic number of rounds, each written to
    the shared folder.  Only a count of moved rows reaches the driver a round.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with(both, "u", "v", how="inner", m=F.min("v")).filter(F.col("v") > F.col("u"))
        large = near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _with(large, "u", "v", how="inner", m=F.min("v"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = written(small)
        moved = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not moved:
            return edges.groupBy("u").agg(F.min("v").alias("class_id")).withColumnRenamed("u", "doc_id")


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, copy_of: the least doc_id with exactly the same text (itself, for a text without words)."""
    hashed = documents.select("doc_id", F.when(F.regexp_like("text", F.lit(_text.WORD_PATTERN)), F.unhex(F.md5("text"))).alias("digest"))
    first = _with(hashed, "digest", "doc_id", "n > 1", copy_of=F.min("doc_id"), n=F.count(F.lit(1)))
    return first.select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"))


def _classes(documents: DataFrame, near: Near) -> DataFrame:
    """doc_id, class_id, copy_of of (doc_id, text) rows whose doc_id is a key.

    Within a band's bucket, the members meet one of them, not each other: the one
    that shares buckets with the most documents, as the text that near copies were
    made from does.  A bucket that then still holds several components goes on:
    the components' members meet only across components, and a pair goes on to the
    exact check once, from the least bucket it shares, and only if the sets' sizes
    and bitmaps allow a link.  So no link between different texts is lost and no
    component pairs within itself.  Copies, buckets, components and classes are dealt
    in parts (_with), and a bucket of more than WIDE members meets itself in slices of
    about WIDE members.
    """
    keyed = written(_keyed(documents))
    firsts = keyed.filter("copy_of = doc_id").select("doc_id")
    own = written(prints(documents, near))
    copies = keyed.filter("copy_of != doc_id").select("doc_id")
    own = own.join(copies, "doc_id", "left_anti") if not copies.isEmpty() else own
    bands = own.select(F.explode("bands").alias("band"), F.col("doc_id").alias("a"))
    shared = _with(bands, "band", "a", "lo < hi", "inner", n=F.count(F.lit(1)), lo=F.min("a"), hi=F.max("a"))
    members = written(shared.select("band", "a", "n").distinct())
    # the document that shares buckets with the most others is most likely what near copies were made from
    known = members.groupBy("a").agg(F.sum("n").alias("met"))
    ranked = members.join(known, "a").select("band", "a", F.struct((-F.col("met")).alias("met"), "a").alias("r"))
    members = written(_with(ranked.withColumnRenamed("r", "own"), "band", "a", how="inner", r=F.min("own")).select("band", "a", F.col("r.a").alias("b")))
    involved = members.select(F.col("a").alias("doc_id")).distinct()
    marks = written(own.select("doc_id", "n", "marks").join(involved, "doc_id", "left_semi"))
    met = members.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = written(_linked(_close(met, marks, near), documents, near))
    found = components(stars)
    # what a bucket's centre did not settle: members of different components meet
    labelled = members.join(found.withColumnRenamed("doc_id", "a"), "a", "left").select("band", "a", F.coalesce("class_id", "a").alias("c"))
    labelled = _with(labelled, "band", "a", "lo < hi", "inner", lo=F.min("c"), hi=F.max("c"), size=F.count(F.lit(1)))
    labelled = written(labelled.select("band", "a", "c", F.ceil(F.col("size") / WIDE).alias("slices")))
    kinds = labelled.groupBy("a").agg(F.collect_set("band").alias("bands"))  # near.bands at most
    labelled = labelled.join(kinds, "a").join(marks.select(F.col("doc_id").alias("a"), "n", F.col("marks").alias("p")), "a")
    x = labelled.select(F.col("band").alias("k"), F.pmod(F.xxhash64("a"), "slices").alias("slice"), "a", F.col("c").alias("ca"), F.col("bands").alias("va"), "n", "p")
    y = labelled.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("at"), F.col("a").alias("b"), F.col("c").alias("cb"), F.col("bands").alias("vb"), F.col("n").alias("m"), F.col("p").alias("q"))
    once = F.col("band") == F.array_min(F.array_intersect("va", "vb"))  # of the bands that a pair shares, the least one brings it
    across = x.join(y, (F.col("k") == F.col("band")) & (F.col("slice") == F.col("at")) & (F.col("ca") < F.col("cb")) & _may_link(near) & once).select("a", "b")
    done = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = written(_linked(across.join(done, ["a", "b"], "left_anti"), documents, near))
    if not more.isEmpty():
        found = components(stars.union(more))
    per_first = firsts.join(found, "doc_id", "left").select(F.col("doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"))
    copied = _with(keyed.filter("copy_of != doc_id"), "copy_of", "doc_id", values=per_first)
    return per_first.select(F.col("copy_of").alias("doc_id"), "class_id", "copy_of").union(copied.select("doc_id", "class_id", "copy_of"))


def _rowed(documents: DataFrame, near: Near) -> tuple[DataFrame, DataFrame, str]:
    """documents written once with a row key, its name, and row, class_row, copy_row, lead (least (null id last, doc_id, row) of the class), copied (least doc_id of the exact copies)."""
    row = free(documents.columns, "_row")
    docs = written(documents.withColumn(row, F.monotonically_increasing_id()))
    found = written(_classes(docs.select(F.col(row).alias("doc_id"), "text"), near).join(docs.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id")), "doc_id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("doc_id").alias("row"))
    # single texts need no look-up; groups are one row each
    led = _with(found, "class_id", "doc_id", "n > 1", lead=F.min(order), n=F.count(F.lit(1))).drop("n")
    out = _with(led, "copy_of", "doc_id", "n > 1", copied=F.min("id"), n=F.count(F.lit(1)))
    return docs, out.select(F.col("doc_id").alias("row"), "id", F.coalesce("lead", order).alias("lead"), F.coalesce("copied", "id").alias("copied")), row


def classes(documents: DataFrame, near: Near | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), copy_of (least doc_id of its exact copies): one row per row of documents.

    A class is a connected component of links of similarity >= near.similarity;
    exact copies are of one class.  Texts that are null or hold no word are classes of
    their own.  Rows that repeat a doc_id are documents of their own, as are rows with
    a null one; a class of such rows alone has a null class_id.  An empty table gives
    no rows; columns beside doc_id and text are not read; texts are compared whole.
    """
    _, found, _ = _rowed(documents.select("doc_id", "text"), near or Near())
    return found.select(F.col("id").alias("doc_id"), F.col("lead.id").alias("class_id"), F.col("copied").alias("copy_of"))


def keep_firsts(documents: DataFrame, near: Near | None = None) -> DataFrame:
    """One row of each class, with all its columns: that of the least doc_id, a null one only where the class has no other."""
    docs, found, row = _rowed(documents, near or Near())
    firsts = found.filter("row = lead.row").select(F.col("row").alias(row))
    return docs.join(firsts, row, "left_semi").select(*documents.columns)
