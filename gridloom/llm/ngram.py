"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Counting goes down the orders.  Each task folds its texts into distinct (context,
word) counts and sends them, packed, to the range of the context's hash.  A range
adds up its blobs as they arrive, appends its sorted arrays to its file, and hands
the next lower order one entry per distinct n-gram, so that each n-gram is counted
by the number of different words before it.  At order 1 the words are left.  A
range holds about RANGE_BYTES of text however large the corpus is; the number of
files stops at FILES, beyond which a file takes more ranges.  A range's memory is
bounded by its distinct n-grams, as blobs are added up whenever enough are held.

Scoring.  Workers map the files into memory, so the operating system shares one
copy a machine and loads only the pages in use, and look up a slice's distinct
n-grams in sorted order.
"""

from __future__ import annotations

import io
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _store, _text

_U = np.uint64
BEGIN, END = _U(0x1234567890ABCDEF), _U(0x0FEDCBA987654321)
#: Texts' bytes for each range of context hashes; files a level at most; n-grams that a task gathers before it sends or adds up.
RANGE_BYTES, FILES, GATHER = 6 << 20, 1 << 16, 3 << 18
#: Ranges of texts' bytes whose words share a file at order 1: distinct words grow slower than texts.
WORDS = 16
#: Files that a worker keeps mapped: all of a table of some 90 GB, as a text asks most of them (a machine allows 65,530 maps).
MAPPED = 1 << 15
#: Text bytes looked up together, least and most, and for each range: a look-up asks most ranges, so the more there are the more is asked at once.
LOOK, LOOK_MOST, LOOK_RANGE = 1 << 20, 1 << 23, 1 << 12


def tokens(data: np.ndarray, offsets: np.ndarray, order: int = 2) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and word hash of all tokens, each text's end included, and the hashes of the 1 … order - 1 words before; A to Z count as a to z.

    A context's last bit says whether it reaches the text's beginning.
    """
    data = _text.lower_ascii(data)
    n = len(offsets) - 1
    starts, ends, rows = _text.words(data, offsets)
    word = _text.spans_hash(data, starts, ends)
    at = np.searchsorted(rows, np.arange(n), "right")  # each text's end goes behind its words
    rows, word = np.insert(rows, at, np.arange(n)), np.insert(word, at, END)
    place = np.arange(len(word)) - np.searchsorted(rows, np.arange(n))[rows]
    contexts: list[np.ndarray] = []
    for k in range(1, order):
        before = np.full(len(word), BEGIN)
        before[k:] = word[:-k]
        before[place < k] = BEGIN
        h = before if k == 1 else _text.mix(contexts[-1] * _U(0x9E3779B97F4A7C15) + before)
        contexts.append((h & ~_U(1)) | (place < k).astype(_U))
    return rows, word, contexts


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _text.mix(context * _U(0x9E3779B97F4A7C15) + word)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, which leaves high zero bytes to the shuffle's compression; each after its length."""
    out = []
    for a in arrays:
        out += [len(a).to_bytes(8, "little"), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()]
    return b"".join(out)


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n, width = int.from_bytes(blob[at : at + 8], "little"), np.dtype(t).itemsize
        out.append(np.frombuffer(blob, np.uint8, n * width, at + 8).reshape(width, n).T.copy("C").reshape(-1).view(t))
        at += 8 + n * width
    return out


def _sum_by(key: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, an index of each, and their summed counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[edge], order[edge], *(np.add.reduceat(x[order], edge) if len(edge) else x[:0] for x in n)


def _spread(x: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, by its high bits: sorted parts make one sorted order."""
    return ((x >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)


def _send(shard: np.ndarray, order_key: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((order_key, shard))
    shard = shard[order]
    edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    ends = np.append(edge[1:], len(shard))
    sorted_arrays = [a[order] for a in arrays]
    blobs = [_pack(*[a[i:j] for a in sorted_arrays]) for i, j in zip(edge.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[edge]), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def _of_counts(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts of counts 1, 2 and 3 or more; 0.5, 0.75 and 1 where there are too few to estimate them."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(found, 1))  # type: ignore[return-value]


@dataclass(frozen=True)
class Model:
    """A stored model: its folder, as workers open it, and its constants."""

    folder: str
    order: int
    files: int
    #: Ranges of context hashes in a file.
    ranges: int
    #: Files of order 1, of one range each.
    words: int
    train_tokens: int
    distinct: int
    #: Discounts of each order, from 1.
    discounts: tuple[tuple[float, float, float], ...]
    #: Sum of the words' counts at order 1, and the weight of the uniform distribution below them.
    mass: int
    rest: float

    def dealt(self, level: int) -> tuple[int, int]:
        """Files of an order, and ranges in each."""
        return (self.words, 1) if level == 1 else (self.files, self.ranges)


def _save(path: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array)
    _store.put(path, out.getvalue())


def _narrow(a: np.ndarray) -> np.ndarray:
    most = a.max(initial=0)
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class _Writer:
    """One file of ranges: their arrays one after the other, then an index file of (place, length, bytes a number) by range and array."""

    def __init__(self, path: str, ranges: int, arrays: int):
        self.path, self.at = path, 0
        self.index = np.zeros((ranges, arrays, 3), np.int64)
        self.file = _store.begin(path)

    def add(self, number: int, *arrays: np.ndarray) -> None:
        for i, a in enumerate(arrays):
            self.index[number, i] = self.at, a.size, a.itemsize
            raw = np.ascontiguousarray(a).tobytes()
            raw += bytes(-len(raw) % 8)
            self.file.write(raw)
            self.at += len(raw)

    def close(self) -> None:
        _store.end(self.file, self.path)
        _save(f"{self.path}.index", self.index)


_TYPES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


class _Mapped:
    """A stored model's files, mapped when first used; the MAPPED last used stay."""

    def __init__(self, model: Model):
        self.model = model
        self.open: OrderedDict[tuple[int, int], tuple | None] = OrderedDict()

    def arrays(self, level: int, part: int) -> list[np.ndarray] | None:
        """The arrays of one range of context hashes, None where it holds nothing."""
        file, number = divmod(part, self.model.dealt(level)[1])
        if (level, file) not in self.open:
            path = f"{self.model.folder}/{level}-{file}"
            try:
                self.open[level, file] = np.load(f"{path}.index"), np.memmap(path, np.uint8, "r")
            except (FileNotFoundError, ValueError):  # a file without entries is empty or was never begun
                self.open[level, file] = None
            if len(self.open) > MAPPED:
                self.open.popitem(last=False)
        self.open.move_to_end((level, file))
        found = self.open[level, file]
        if found is None or not found[0][number, 0, 1]:
            return None
        return [found[1][at : at + size * width].view(_TYPES[width]) for at, size, width in found[0][number].tolist()]

    def look_up(self, level: int, keys: int, values: list[int], part: np.ndarray, key: np.ndarray, width: int = 1) -> np.ndarray:
        """Values (one column for each array of `values`, or `width` columns of one) of the distinct keys, 0 where unknown."""
        out = np.zeros((len(key), max(width, len(values))), np.int64)
        order = np.lexsort((key, part))
        part, key = part[order], key[order]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(part) else []
        for i, j in zip(edge, [*edge[1:], len(part)], strict=True):
            arrays = self.arrays(level, int(part[i]))
            if arrays is None:
                continue
            known = arrays[keys]
            at = np.minimum(np.searchsorted(known, key[i:j]), len(known) - 1)
            same = np.flatnonzero(known[at] == key[i:j])
            for c, v in enumerate(values):
                got = arrays[v].reshape(len(known), -1)[at[same]]
                out[order[i + same], c : c + got.shape[1]] = got
        return out


def _reduced(level: int, order: int, folder: str, ranges: int, below: int):
    """The mapInArrow function of one level: rows (shard, blob) sorted by shard, in whole files, become stored ranges and the next level's rows, dealt to `below` ranges.

    Rows with shard -1 carry statistics: the level's counts of counts; at order 1 also the sums.
    """
    lower = level - 1
    top = level == order
    types = [np.uint64] * level + ([np.uint32] if top else [np.uint64, np.uint64])  # contexts from the longest, word, count, and below the top the tokens behind it

    def added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        names, counts = columns[:level], [c.astype(np.int64) for c in columns[level:]]
        key, at, *counts = _sum_by(gram_key(names[0], names[-1]) if level > 1 else names[0], *counts)
        return [*(c[at] for c in names), *counts, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: _Writer | None = None
        out: list[list[np.ndarray]] = []
        parts: list[list[np.ndarray]] = []
        held = sent = 0
        stats = np.zeros(7, np.int64)
        current = -1

        def finish() -> None:
            """Stores the range that is complete."""
            nonlocal writer, parts, held, sent, stats
            *columns, key = added(parts)
            n, raw = columns[level], columns[-1]
            columns = columns[:level]
            parts, held = [], 0
            file, number = divmod(current, ranges)
            path = f"{folder}/{level}-{file}"
            if writer is None or writer.path != path:
                if writer is not None:
                    writer.close()
                writer = _Writer(path, ranges, 4 if level > 1 else 3)
            stats[:4] += _of_counts(n)
            if level == 1:
                writer.add(number, key, _narrow(n), _narrow(raw))
                stats[4:] += int(n.sum()), len(n), int(raw.sum())
                return
            context, which = np.unique(columns[0], return_inverse=True)
            of = [np.bincount(which, w, len(context)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
            writer.add(number, key, _narrow(n), context, _narrow(np.stack(of, axis=1)))
            # one entry a distinct n-gram; those that reach the text's beginning have nothing before it to tell apart and keep their counts
            once = np.where((columns[1] & _U(1)) == 1, n, 1) if level > 2 else np.ones(len(n), np.int64)
            key = gram_key(columns[1], columns[-1]) if level > 2 else columns[-1]
            _, at, n, raw = _sum_by(key, once, raw)
            out.append([*(c[at] for c in columns[1:]), n, raw])
            sent += len(at)

        def flush() -> pa.RecordBatch:
            nonlocal out, sent
            *columns, n, raw = (np.concatenate(x) for x in zip(*out, strict=True))
            key, at, n, raw = _sum_by(gram_key(columns[0], columns[-1]) if lower > 1 else columns[0], n, raw)
            columns = [c[at] for c in columns]
            out, sent = [], 0
            return _send(_spread(_text.mix(columns[0]), below), columns[0], *columns, n.astype(np.uint64), raw.astype(np.uint64))

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != current and parts:
                    finish()
                    if sent > GATHER:
                        yield flush()
                current = shard
                parts.append(_unpack(blob.as_py(), *types))
                held += len(parts[-1][0])
                if held > GATHER and len(parts) > 1:
                    parts = [added(parts)[:-1]]
                    held = len(parts[0][0]) // 2  # added up again once it has grown by half
        if parts:
            finish()
        if writer is not None:
            writer.close()
        if out:
            yield flush()
        if current >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([stats.tobytes()], pa.binary())], names=["shard", "blob"])

    return run


def train(texts: DataFrame, order: int = 3) -> Model:
    """The model of all rows' whole texts (column text; null: empty), of n-grams up to `order` (2 or more)."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, math.ceil(size / RANGE_BYTES))
    ranges = math.ceil(parts / FILES)
    files = math.ceil(parts / ranges)
    words = min(FILES, max(8, math.ceil(parts / WORDS)))
    folder = _store.mounted(_store.shared_dir(spark))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            *columns, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, n = _sum_by(gram_key(columns[0], columns[-1]), n)
            columns, n = [c[at] for c in columns], n.astype(np.uint32)
            return _send(_spread(_text.mix(columns[0]), files * ranges), columns[0], *columns, n)

        for batch in batches:
            for _, _, data, offsets in _text.slices(batch.column(0)):
                _, word, contexts = tokens(data, offsets, order)
                _, at, n = _sum_by(gram_key(contexts[-1], word), np.ones(len(word), np.int64))
                held.append([*(c[at] for c in reversed(contexts)), word[at], n])
                n_held += len(at)
                if n_held > GATHER:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    rows = texts.select("text").mapInArrow(count, "shard int, blob binary")
    discounts, stats = [], np.zeros(7, np.int64)
    for level in range(order, 0, -1):
        # one task a file, in order of its ranges
        n_files, each = (words, 1) if level == 1 else (files, ranges)
        dealt = rows.repartitionById(n_files, F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")
        done = _store.written(dealt.mapInArrow(_reduced(level, order, folder, each, words if level == 2 else files * ranges), "shard int, blob binary"))
        stats = np.sum([np.frombuffer(r["blob"], np.int64) for r in done.filter("shard = -1").collect()] or [np.zeros(7, np.int64)], axis=0)  # one small row a task
        discounts.append(_discounts(stats[:4].tolist()))
        rows = done.filter("shard >= 0")
    mass, distinct, train_tokens = (int(x) for x in stats[4:])
    d, (n1, n2) = discounts[-1], stats[:2].tolist()
    rest = (d[0] * n1 + d[1] * n2 + d[2] * (distinct - n1 - n2)) / mass if mass else 1.0
    return Model(folder, order, files, ranges, words, train_tokens, distinct, tuple(reversed(discounts)), mass, rest)


def _minus(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n == 0, 0.0, np.where(n == 1, n - d[0], np.where(n == 2, n - d[1], n - d[2])))


_opened: dict[str, _Mapped] = {}


def _together(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """First row, end row and tokens() of slices that are looked up at once."""
    most = max(LOOK, min(LOOK_MOST, LOOK_RANGE * model.files * model.ranges))
    held: list[tuple] = []
    begin = size = 0

    def joined(end: int):
        rows, word, contexts = zip(*held, strict=True)
        return begin, end, np.concatenate(rows), np.concatenate(word), [np.concatenate(c) for c in zip(*contexts, strict=True)]

    for lo, hi, data, offsets in _text.slices(column, 2 * _text.SLICE_BYTES):
        rows, word, contexts = tokens(data, offsets, model.order)
        held.append((rows + (lo - begin), word, contexts))
        size += len(data)
        if size + LOOK > most:  # a slice more would go beyond
            yield joined(hi)
            held, begin, size = [], hi, 0
    if held:
        yield joined(len(column))


def _score(mapped: _Mapped, n: int, rows: np.ndarray, word: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of n texts by their tokens."""
    m = mapped.model
    place = lambda h, level: _spread(_text.mix(h), math.prod(m.dealt(level)))
    every, which = np.unique(word, return_inverse=True)
    of_word = mapped.look_up(1, 0, [1, 2], place(every, 1), every)
    seen = of_word[:, 1]
    p = (_minus(of_word[:, 0], m.discounts[0]) / max(m.mass, 1) + m.rest / (m.distinct + 1))[which]
    for level in range(2, m.order + 1):
        context, d = contexts[level - 2], m.discounts[level - 1]
        known, back = np.unique(context, return_inverse=True)
        total, *few = mapped.look_up(level, 2, [3], place(known, level), known, 4).T
        kept = (d[0] * few[0] + d[1] * few[1] + d[2] * few[2]) / np.maximum(total, 1)
        gram, first, at = np.unique(gram_key(context, word), return_index=True, return_inverse=True)
        count = mapped.look_up(level, 0, [1], place(context[first], level), gram)[at, 0]
        total, kept = total[back], kept[back]
        p = np.where(total > 0, _minus(count, d) / np.maximum(total, 1) + kept * p, p)
    base = np.log10((seen + 1) / (m.train_tokens + m.distinct + 1))
    return [_text.counts(rows, n), _text.counts(rows[seen[which] > 0], n), np.bincount(rows, base[which], n), np.bincount(rows, np.log10(p), n)]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of each whole text.

    score is the model's log10 probability of the text's words and end.  Null and
    empty texts are one end.  A model of no text gives every token 1 / (0 + 1).
    Rows that repeat a doc_id, or have a null one, are scored each alone; in
    training every row counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _opened:
            _opened.clear()
            _opened[model.folder] = _Mapped(model)
        for batch in batches:
            for lo, hi, *found in _together(batch.column(1), model):
                n, known, base, total = _score(_opened[model.folder], hi - lo, *found)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(known), pa.array(np.full(hi - lo, model.train_tokens)), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
