"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Each index block holds, per dimension, its vectors' places grouped by quantised
value: the posting segments.  For a query, a segment's impact is how far its
contribution is above the dimension's least.  Segments of all dimensions are
processed by descending quantised impact, level by level; every vector keeps a
partial score and the number of dimensions seen.  What is unseen can add at most
the next level a dimension, so after a level the vectors that may still be
members are known; once there are few, which is the proof, these are rescored
exactly.

Blocks and query chunks are stored once in the shared folder and mapped by the
workers.  What Spark deals out are pairs of names: a group of blocks and a chunk of
queries.  Inside a group a query takes the blocks in order of their bounds and
carries its k-th score on: a block whose bound lies below it is not opened.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _store

#: Vectors in an index block (at most 65,536, places have 16 bits); blocks in a group; queries in a chunk.
BLOCK, GROUP, CHUNK = 8192, 16, 128
#: Values of one posting segment, and the number of impact levels of a query.
STEP, LEVELS = 4, 12
#: Whole numbers below this size have exact float64 sums.
_EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * x), x as double), row (a key) of the usable vectors: not null, without null or non-finite components; written once.

    Rows that repeat a vec_id are vectors of their own; a null vec_id takes no part.
    Numbers beyond 64 bits count as the nearest 64-bit integer.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return _store.written(ints.withColumn("row", F.monotonically_increasing_id()))


def _save(path: str, *arrays: np.ndarray) -> None:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a)
    _store.put(path, out.getvalue())


def _load(path: str, n: int) -> list[np.ndarray]:
    with open(path, "rb") as f:
        return [np.load(f) for _ in range(n)]


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, row keys and vectors of a task's (vec_id, row, v), `size` rows at a time; vectors of another length form blocks of their own."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        lists = batch.column(2)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        for width in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == width)
            own = held.setdefault(width, [[], [], []])
            for k in (0, 1):
                own[k].append(batch.column(k).to_numpy(zero_copy_only=False)[at])
            own[2].append(flat[(ends[at] - width)[:, None] + np.arange(width)])
            while sum(map(len, own[0])) >= size:
                whole = [np.concatenate(x) for x in own]
                yield tuple(x[:size] for x in whole)  # type: ignore[misc]
                held[width] = own = [[x[size:]] for x in whole]
    for own in held.values():
        if sum(map(len, own[0])):
            yield tuple(np.concatenate(x) for x in own)  # type: ignore[misc]


def _stored(rows: DataFrame, folder: str, kind: str, size: int) -> DataFrame:
    """width, file: what (vec_id, v, row) rows were stored as, `size` rows a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (ids, keys, v) in enumerate(_matrices(batches, size)):
            name = f"{folder}/{kind}-{part}-{k}"
            if kind == "block":
                most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
                small = v.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
                _save(name, ids, keys, v.min(axis=0), v.max(axis=0), small, np.ascontiguousarray(np.argsort(v, axis=0, kind="stable").astype(np.uint16).T))
            else:
                _save(name, ids, keys, v)
            yield pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([name])], names=["width", "file"])

    return _store.written(rows.select("vec_id", "row", "v").mapInArrow(run, "width int, file string"))


class Block:
    """One index block, opened for search."""

    def __init__(self, path: str):
        self.ids, self.rows, _, _, v, places = _load(path, 6)
        self.most = max(int(v.max()), -int(v.min()))
        self.whole = v
        self.v = v.astype(np.float64)
        self.places = places.astype(np.intp)
        width, n = places.shape
        values = np.take_along_axis(v.T.astype(np.int64), self.places, axis=1)
        new = np.ones((width, n), bool)
        new[:, 1:] = values[:, 1:] // STEP != values[:, :-1] // STEP
        flat = np.flatnonzero(new)
        #: Segments in order of dimension and value: dimension, first place, end, least and greatest value.
        self.dim, self.first = flat // n, flat % n
        ends = np.append(flat[1:], width * n)
        self.size = ends - flat
        self.low, self.high = values.reshape(-1)[flat], values.reshape(-1)[ends - 1]
        self.begin = np.searchsorted(self.dim, np.arange(width + 1))
        self.least, self.greatest = values[:, 0], values[:, -1]
        self.digit = 1 << width.bit_length()

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int, int]]:
        """(-score, id, row) of the members of the query's top k that the block can have, its own row left out; least: a score that members reach."""
        n, width = self.v.shape
        exact = self.most * max(int(query.max()), -int(query.min())) * width * 2 * self.digit < _EXACT
        if not exact:
            live = np.flatnonzero(self.rows != own)
            score = self.whole[live].astype(object) @ query.astype(object)
        else:
            live = self._candidates(query, own, k, least) if n > 8 * k else np.arange(n)
            live = live[self.rows[live] != own]
            score = (self.v[live] @ query.astype(np.float64)).astype(np.int64)
        best = np.lexsort((self.rows[live], self.ids[live], -score))[:k] if exact else sorted(range(len(live)), key=lambda i: (-score[i], self.ids[live[i]], self.rows[live[i]]))[:k]
        return [(-int(score[i]), int(self.ids[live[i]]), int(self.rows[live[i]])) for i in best]

    def _candidates(self, q: np.ndarray, own: int, k: int, known: int | None) -> np.ndarray:
        """Places of a superset of the members: segments by descending impact, until few can still be members."""
        n, width = self.v.shape
        size, up = np.abs(q), q >= 0
        qs, ups = size[self.dim], up[self.dim]
        least = qs * np.where(ups, self.low - self.least[self.dim], self.greatest[self.dim] - self.high)  # a segment's impact is at least this
        most = qs * np.where(ups, self.high - self.least[self.dim], self.greatest[self.dim] - self.low)  # and at most this
        hidden = int((np.maximum.reduceat(most - least, self.begin[:-1])).sum())
        reach = size * (self.greatest - self.least)
        top = int(reach.max())
        if top == 0:
            return np.arange(n)
        mine = np.flatnonzero(self.rows == own)
        base = int(np.where(up, q * self.least, q * self.greatest).sum())  # what every vector has
        sums = np.zeros(n)
        # how far each dimension is processed: segments [begin, done) from the low end or [done, end) from the high end
        done = np.where(up, self.begin[1:], self.begin[:-1])
        for s in range(1, LEVELS + 1):
            bar = top * (LEVELS - s) // LEVELS
            over = np.add.reduceat((most > bar).astype(np.int64), self.begin[:-1])  # impacts fall along a dimension, so these are at one end
            now = np.where(up, self.begin[1:] - over, self.begin[:-1] + over)
            places, gains, sizes = [], [], []
            for d in np.flatnonzero(now != done).tolist():
                a, b = (now[d], done[d]) if up[d] else (done[d], now[d])
                places.append(self.places[d, self.first[a] : self.first[b - 1] + self.size[b - 1]])
                gains.append(least[a:b])
                sizes.append(self.size[a:b])
            done = now
            if places:
                gain = np.repeat(np.concatenate(gains) * float(self.digit) + 1.0, np.concatenate(sizes))
                sums += np.bincount(np.concatenate(places), gain, n)  # the partial score and, in the low digits, the dimensions seen
            if s < LEVELS // 2:
                continue
            seen = (sums % self.digit).astype(np.int64)
            partial = (sums - seen) / self.digit
            partial[mine] = -1
            # what unseen dimensions can add: the greatest of them, each at most the bar
            ahead = np.concatenate(([0], np.cumsum(np.sort(np.minimum(reach, bar))[::-1])))
            proof = np.partition(partial, n - k)[n - k]
            proof = proof if known is None else max(proof, known - base)
            live = np.flatnonzero(partial + ahead[width - seen] + hidden >= proof)
            if len(live) <= max(8 * k, n // 16):
                return live
        return live


def _bound(path: str, q: np.ndarray) -> list[int]:
    """For each query, what no vector of the block exceeds."""
    _, _, least, greatest = _load(path, 4)
    if max(map(abs, (int(least.min()), int(greatest.max())))) * max(int(q.max()), -int(q.min())) * q.shape[1] < _EXACT:
        return np.maximum(q * least, q * greatest).sum(axis=1).tolist()
    return np.maximum(q.astype(object) * least, q.astype(object) * greatest).sum(axis=1).tolist()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k greatest inner products among all other vectors, ties to the smaller vec_id, then row.

    Both are (vec_id, v, row) of quantised(); a row is not its own candidate, other
    rows of its vec_id are.  Rows that repeat a query's vec_id are queries of their
    own under one query_id.  Vectors of another length than the query's are no
    candidates.  Ranks follow the exact sums; a score beyond 64 bits is shown as the
    nearest 64-bit integer.  Empty tables give no rows.  Every query meets every
    group of blocks, as an exact search must, but as a pair of names.
    """
    folder = _store.mounted(_store.shared_dir(vectors.sparkSession))
    blocks, chunks = _stored(vectors, folder, "block", BLOCK), _stored(queries.repartition(max(1, math.ceil(queries.count() / CHUNK))), folder, "chunk", 2 * CHUNK)
    n_groups = max(1, math.ceil(blocks.count() / GROUP))
    grouped = blocks.groupBy("width", F.pmod(F.xxhash64("file"), F.lit(n_groups)).alias("g")).agg(F.sort_array(F.collect_list("file")).alias("blocks"))  # about GROUP names
    asked = chunks.select("width", F.col("file").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g"))
    pairs = _store.written(asked.join(grouped, ["width", "g"]).select("chunk", "blocks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows, q = _load(chunk, 3)
                best: list[list[tuple[int, int, int]]] = [[] for _ in ids]
                bounds = {name: _bound(name, q) for name in names}
                for name in sorted(names, key=lambda x: -sum(bounds[x])):
                    block = None
                    for i, own in enumerate(rows.tolist()):
                        least = -best[i][-1][0] if len(best[i]) == k else None
                        if least is None or bounds[name][i] >= least:
                            block = block or Block(name)
                            best[i] = sorted(best[i] + block.search(q[i], own, k, least))[:k]
                flat = [(int(ids[i]), int(rows[i]), v, r, -s) for i, found in enumerate(best) for s, v, r in found]
                columns = [pa.array([f[j] for f in flat], pa.int64()) for j in range(4)]
                clipped = [min(max(f[4], -(1 << 63)), (1 << 63) - 1) for f in flat]
                keys = [(f[4] + (1 << 199)).to_bytes(25, "big") for f in flat]  # bytes in the order of the scores
                yield pa.RecordBatch.from_arrays([*columns, pa.array(clipped, pa.int64()), pa.array(keys, pa.binary())], names=["query_id", "query_row", "vec_id", "row", "score", "key"])

    dealt = pairs.repartition(max(8, min(pairs.count(), 1 << 17)))
    found = dealt.mapInArrow(search, "query_id long, query_row long, vec_id long, row long, score long, key binary")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("key"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
