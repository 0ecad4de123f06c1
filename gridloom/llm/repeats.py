"""Repeated byte strings across documents, found by sorting suffixes bucket by bucket.

A byte goes when a string of `length` bytes over it also starts in a document
with a smaller id.  Sorting all suffixes at once would need a record a byte, so:

1. Suffixes fall into buckets by anchor: the least hash among the seeds (shorter
   strings) of the suffix's first `length` bytes.  Equal strings have equal
   anchors, and neighbouring suffixes share one, so a bucket holds short segments.
2. Buckets whose anchor lies in one document only cannot hold a repeat and are
   dropped before any text moves; tasks send each anchor once.
3. The rest is sorted one bucket at a time.  Suffixes are ordered by their first
   8 bytes; longer ties are resolved by precomputed ranks of cover samples, every
   8th place counted back from the anchor.  (Equal suffixes lie equally far from
   their anchor, so this one residue class covers every difference that a general
   difference cover must; each suffix meets a sample within 8 bytes.)  Tasks send
   equal segments once, with their least document, so copies do not pile up.
   The strings of an anchor that very many segments share go to buckets of their
   own hash instead, so that a common phrase does not fill one bucket.
4. A bucket's repeated strings, with their least documents, are stored as sorted
   arrays in the shared folder; workers map them into memory and cut each text.  A
   string is known by its bucket, 64 bits of a hash and 8 bits of another: of 10**13
   strings looked up in buckets of a million, chance finds about 0.002.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _store, _text
from gridloom.llm.ngram import _pack, _save, _send, _spread, _unpack

_U = np.uint64
#: Text bytes for each bucket file; anchors, or 1/48 of the segment bytes, that a task gathers before it sends them.
SHARD_BYTES, GATHER = 16 << 20, 1 << 19
#: Text bytes hashed together, small enough for a processor's cache; places, or text bytes at least, looked up together, so that a file is asked seldom.
SLICE, LOOK = 1 << 17, 1 << 20
#: Text bytes whose anchors are looked up together: so many a bucket file, as a look-up asks most files, and at most.
LOOK_FILE, LOOK_MOST = 1 << 13, 1 << 23
#: Suffixes sorted together; files that a worker keeps mapped: all of a table of some 50 GB, as a text asks most of them (a machine allows 65,530 maps).
SORTED, MAPPED = 1 << 18, 1 << 15
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeat; seed: bytes of a seed (24 or more; the segment of an anchor spans length - seed more);
    hot: segments from which an anchor's strings are dealt out by their own hash."""

    length: int = 50
    seed: int = 24
    hot: int = 1 << 16

    def __post_init__(self):
        if self.seed < 24 or self.length < self.seed + 18:
            raise ValueError("a repeat needs a seed of 24 bytes and 18 bytes more")


def _words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8-byte integer that starts at each byte (past the end: zeros)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), f"{order}u8", buffer=padded, strides=(1,))


def anchors(data: np.ndarray, offsets: np.ndarray, how: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """For each place where `length` bytes of one text start: its anchor's place; and the hashes of all seeds.

    Places without that many bytes have anchor -1.  Of equal least hashes the leftmost counts.
    """
    n = len(data)
    words = _words_at(data)
    m = max(n - how.seed + 1, 0)
    seeds = words[:m] * _U(0x9E3779B97F4A7C15)
    seeds ^= seeds >> _U(29)
    seeds += words[8 : 8 + m]
    seeds *= _U(0xC2B2AE3D27D4EB4F)
    seeds ^= seeds >> _U(31)
    seeds += words[16 : 16 + m]
    seeds *= _U(0x165667B19E3779F9)
    for k in range(24, how.seed):
        seeds ^= seeds >> _U(31)
        seeds += data[k : k + m]
        seeds *= _U(0x27D4EB2F165667C5)
    seeds ^= seeds >> _U(32)
    out = np.full(n, -1, np.int64)
    reach = how.length - how.seed + 1
    if m < reach:
        return out, seeds
    bits = _U(max(20, n.bit_length()))
    key = seeds >> bits
    key <<= bits
    key |= np.arange(m, dtype=_U)
    span = 1
    while 2 * span <= reach:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < reach:
        key = np.minimum(key[: len(key) - (reach - span)], key[reach - span :])
    out[: len(key)] = (key & ((_U(1) << bits) - _U(1))).astype(np.int64)
    # the last length - 1 places of each text start no string of that many bytes
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, np.maximum(offsets[1:] - how.length + 1, offsets[:-1]), 1)
    np.add.at(inside, offsets[1:], -1)
    out[np.cumsum(inside[:n]) > 0] = -1
    return out, seeds


def _segments(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of places with one anchor."""
    change = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    ends = np.append(change[1:], len(anchor))
    some = anchor[change] >= 0
    return change[some], ends[some]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _least(key: np.ndarray, doc: np.ndarray, many: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least document, whether several documents have them, and their segments' number."""
    order = np.lexsort((doc, key))
    key, doc, many = key[order], doc[order], many[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    several = (np.maximum.reduceat(doc, edge) != doc[edge]) | np.logical_or.reduceat(many, edge)
    return key[edge], doc[edge], several, np.add.reduceat(n[order], edge)


def _check(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """8 bits of a second hash of the `length` bytes at each place, by their 8-byte words."""
    word = _words_at(data)
    h = word[places]
    for k in (*range(8, length - 8, 8), length - 8):
        h ^= h >> _U(29)
        h *= _U(0x9E3779B97F4A7C15)
        h += word[places + k]
    h *= _U(0xC2B2AE3D27D4EB4F)
    return (h >> _U(56)).astype(np.uint8)


def _save_keys(folder: str, name: str, shard: int, keys: np.ndarray) -> None:
    """Sorted hashes, and where those with each beginning start, about eight hashes apart: a search then touches one or two memory lines."""
    bits = max(1, len(keys).bit_length() - 4)
    starts = np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << _U(64 - bits))
    _save(f"{folder}/{name}-{shard}.npy", keys)
    _save(f"{folder}/{name}-starts-{shard}.npy", np.append(starts, len(keys)).astype(np.uint32))


def _find(keys: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted hash is in the sorted keys, or would be."""
    begin = (wanted >> _U(64 - (len(starts) - 1).bit_length() + 1)).astype(np.int64)
    low, high = starts[begin].astype(np.int64), starts[begin + 1].astype(np.int64)
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = keys[np.minimum(mid, len(keys) - 1)] < wanted
        less &= low < high
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    return low


@dataclass(frozen=True)
class Found:
    """Where the repeats of a table are stored."""

    folder: str
    shards: int
    how: Repeats
    #: Whether some anchor's strings are dealt out by their own hash.
    hot: bool = False


class _Maps:
    """A table's files, mapped when first used; the MAPPED last used stay."""

    def __init__(self, found: Found):
        self.found, self.maps = found, OrderedDict()

    def get(self, name: str, shard: int) -> np.ndarray | None:
        if (name, shard) not in self.maps:
            try:
                self.maps[name, shard] = np.load(f"{self.found.folder}/{name}-{shard}.npy", mmap_mode="r").view(np.ndarray)
            except (FileNotFoundError, ValueError):  # nothing stored, or an array of no length, which can't be mapped
                self.maps[name, shard] = None
            if len(self.maps) > MAPPED:
                self.maps.popitem(last=False)
        self.maps.move_to_end((name, shard))
        return self.maps[name, shard]

    def look_up(self, keys: str, shard: np.ndarray, key: np.ndarray, *values: str) -> np.ndarray | list[np.ndarray]:
        """Whether each key is stored or, with values, its values (the largest integer where unknown)."""
        out = [np.full(len(key), _LAST) for _ in values] or [np.zeros(len(key), bool)]
        if len(key):
            order = np.lexsort((key, shard))
            s, k = shard[order], key[order]
            edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            for i, j in zip(edge.tolist(), np.append(edge[1:], len(s)).tolist(), strict=True):
                known = self.get(keys, int(s[i]))
                if known is None or not len(known):
                    continue
                at = np.minimum(_find(known, self.get(f"{keys}-starts", int(s[i])), k[i:j]), len(known) - 1)
                same = known[at] == k[i:j]
                if not values:
                    out[0][order[i:j]] = same
                for o, name in zip(out, values, strict=False):
                    o[order[i:j][same]] = self.get(name, int(s[i]))[at[same]]
        return out if values else out[0]


_opened: dict[str, _Maps] = {}


def _maps(found: Found) -> _Maps:
    if found.folder not in _opened:
        _opened.clear()
        _opened[found.folder] = _Maps(found)
    return _opened[found.folder]


def sort_bucket(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of segments by their first `length` bytes.

    text: all segments' bytes; starts, sizes: each segment's; anchor: its anchor,
    from its start.  Returns the suffixes' places in order, their segments, and
    whether each differs from the one before it.
    """
    n = sizes - length + 1
    total = int(n.sum())
    segment = np.repeat(np.arange(len(starts)), n)
    step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    place = starts[segment] + step
    ahead = (starts + anchor)[segment] - place  # to the anchor
    delta = ahead % 8
    sample = place + delta
    depth = length - 8  # a sample's rank covers this many bytes
    word = _words_at(text, ">")
    cover, which = np.unique(sample, return_inverse=True)
    parts = [word[cover + min(k, depth - 8)] for k in range(0, depth, 8)]
    order = np.lexsort(parts[::-1])
    fresh = np.zeros(len(order), bool)
    for p in parts:
        fresh[1:] |= p[order][1:] != p[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    keys = [word[place], rank[which] * 8 + delta, word[place + length - 8]]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return place[order], segment[order], new


def _take(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one span after the other."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    i = 0
    while i < len(starts):  # an index of each byte, for about a megabyte at a time
        low = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, low + (1 << 20), "right")))
        some = sizes[i:j]
        at = np.repeat(starts[i:j] - (ends[i:j] - some - low), some)
        at += np.arange(len(at))
        out[low : low + len(at)] = text[at]
        i = j
    return out


def _span_hashes(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skip: np.ndarray | int = 0, length: int | None = None) -> np.ndarray:
    """The hash of each of consecutive spans or, with length, of that many of its bytes from `skip` on."""
    out = [np.zeros(0, _U)]
    for i in range(0, len(starts), 4096):
        j = min(i + 4096, len(starts))
        low = int(starts[i])
        at = starts[i:j] - low + (skip if isinstance(skip, int) else skip[i:j])
        out.append(_text.spans_hash(text[low : int(starts[j - 1] + sizes[j - 1])], at, at + (sizes[i:j] if length is None else length)))
    return np.concatenate(out)


def _distinct(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One segment of each kind, its least document, and whether several documents have it."""
    same = _text.mix(_span_hashes(text, starts, sizes) + anchor.astype(_U))
    order = np.lexsort((doc, same))
    new = np.concatenate(([True], same[order][1:] != same[order][:-1]))[: len(order)]
    word = np.lib.stride_tricks.sliding_window_view(text, 8)
    ends = (np.ascontiguousarray(word[at]).view(np.uint64)[:, 0] for at in (starts, starts + sizes - 8))
    for part in (sizes, *ends):  # of one hash only those that begin and end alike
        new[1:] |= part[order][1:] != part[order][:-1]
    edge = np.flatnonzero(new)
    many = (np.maximum.reduceat(doc[order], edge) != doc[order][edge]) | np.logical_or.reduceat(many[order], edge)
    return order[edge], doc[order][edge], many


@dataclass
class _Piece:
    """A slice of texts and its segments whose anchors several documents have; anchor: each one's place."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    end: np.ndarray
    shard: np.ndarray
    hot: np.ndarray

    def doc(self, place: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, place, "right") - 1]


def _groups(column: pa.Array, ids: np.ndarray, found: Found) -> Iterator[list[_Piece]]:
    """Slices of the texts whose segments are looked up at once: more of them together, the more files there are."""
    maps, how = _maps(found), found.how
    most = max(LOOK, min(LOOK_MOST, LOOK_FILE * found.shards))
    group: list[_Piece] = []
    keys: list[np.ndarray] = []
    held = 0

    def known() -> list[_Piece]:
        key = np.concatenate(keys)
        shard = _spread(key, found.shards)
        kept = maps.look_up("seeds", shard, key)
        hot = maps.look_up("hot", shard, key) if found.hot else np.zeros(len(key), bool)
        begin = 0
        for piece in group:
            own = slice(begin, begin + len(piece.first))
            begin = own.stop
            some = kept[own]
            piece.anchor, piece.first, piece.end, piece.shard, piece.hot = piece.anchor[some], piece.first[some], piece.end[some], shard[own][some], hot[own][some]
        return group

    for lo, hi, data, offsets in _text.slices(column, SLICE):
        anchor, hashes = anchors(data, offsets, how)
        first, end = _segments(anchor)
        keys.append(_text.mix(hashes[anchor[first]]))
        group.append(_Piece(lo, hi, data, offsets, ids[lo:hi], anchor[first], first, end, first, first))
        held += len(data)
        if held >= most:
            yield known()
            group, keys, held = [], [], 0
    if group:
        yield known()


def _known(column: pa.Array, ids: np.ndarray, found: Found) -> Iterator[_Piece]:
    for group in _groups(column, ids, found):
        yield from group


def find(documents: DataFrame, how: Repeats | None = None) -> Found:
    """Finds and stores all strings of how.length bytes that start in two or more of documents' texts, with the least doc_id of each."""
    how = how or Repeats()
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text").filter("text is not null")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, math.ceil(size / SHARD_BYTES))
    found = Found(_store.mounted(_store.shared_dir(spark)), shards, how)
    folder = found.folder

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, doc, many, n = _least(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return _send(_spread(key, shards), key, key, doc, many, n.astype(np.uint32))

        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, _, data, offsets in _text.slices(batch.column(1), SLICE):
                anchor, hashes = anchors(data, offsets, how)
                first, _ = _segments(anchor)
                if len(first):
                    doc = ids[lo + np.searchsorted(offsets, first, "right") - 1]
                    parts.append((_text.mix(hashes[anchor[first]]), doc, np.zeros(len(first), bool), np.ones(len(first), np.int64)))
                    held += len(first)
                if held > GATHER:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()
            parts = []
        _text.release()

    def shared_seeds(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        loaded = [_unpack(b.as_py(), np.uint64, np.int64, np.bool_, np.uint32) for b in table.column("blob")]
        seed, _, several, n = _least(*(np.concatenate(x) for x in zip(*loaded, strict=True)))
        _save_keys(folder, "seeds", shard, seed[several])
        _save_keys(folder, "hot", shard, seed[several & (n > how.hot)])
        return pa.table({"n": pa.array([int((several & (n > how.hot)).sum())])})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            shard, size, anchor, doc, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts = np.cumsum(size) - size
            at, doc, many = _distinct(text, starts, size, anchor, doc, np.zeros(len(doc), bool))
            order = np.argsort(shard[at], kind="stable")
            at, doc, many = at[order], doc[order], many[order]
            shard, size, anchor, starts = shard[at], size[at], anchor[at], starts[at]
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            blobs = []
            for i, j in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist(), strict=True):
                own = _take(text, starts[i:j], size[i:j])
                whole = _pack(size[i:j].astype(np.uint32), anchor[i:j].astype(np.uint32), doc[i:j], many[i:j]) + own.tobytes()
                blobs.append(len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(shard[edge]), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            ids = _ids(batch.column(0))
            for piece in _known(batch.column(1), ids, found):
                first, end, shard, hot, anchor = piece.first, piece.end, piece.shard, piece.hot, piece.anchor
                if hot.any():  # one segment a string
                    n = (end - first)[hot]
                    single = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    shard = np.concatenate((shard[~hot], _spread(_text.spans_hash(piece.data, single, single + how.length), shards)))
                    first, end = np.concatenate((first[~hot], single)), np.concatenate((end[~hot], single + 1))
                    anchor = np.concatenate((anchor[~hot], np.repeat(anchor[hot], n)))
                if len(first):
                    size = end - first + how.length - 1
                    parts.append((shard, size, anchor - first, piece.doc(first), _take(piece.data, first, size)))
                    held += int(size.sum())
                if held > 48 * GATHER:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()
            parts = []
        _text.release()

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def together() -> None:
            """Equal segments of several tasks count once."""
            nonlocal parts, held
            sizes, anchor, doc, many, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts = np.cumsum(sizes) - sizes
            at, doc, many = _distinct(text, starts, sizes, anchor, doc, many)
            at, doc, many = at[order := np.argsort(at)], doc[order], many[order]
            parts = [(sizes[at], anchor[at], doc, many, _take(text, starts[at], sizes[at]))]
            held = 0

        for blob in table.column("blob"):
            blob = blob.as_py()
            blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
            a, b, c, d = _unpack(blob, np.uint32, np.uint32, np.int64, np.bool_)
            parts.append((a.astype(np.int64), b.astype(np.int64), c, d, np.frombuffer(blob, np.uint8, count=int(a.sum()), offset=len(blob) - int(a.sum()))))
            held += len(parts[-1][4])
            if held > 32 * GATHER and held > len(parts[0][4]):
                together()
        together()
        ((sizes, anchor, doc, many, text),) = parts
        starts = np.cumsum(sizes) - sizes
        # equal strings have equal seeds: a seed's hash deals the segments out to buckets that are sorted one at a time
        seed = _span_hashes(text, starts, sizes, anchor, how.seed)
        bucket = _spread(seed, max(1, int((sizes - how.length + 1).sum()) // SORTED))
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
        made = []
        for i, j in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), strict=True):
            some = order[i:j]
            size = sizes[some]
            own = _take(text, starts[some], size)
            place, segment, new = sort_bucket(own, np.cumsum(size) - size, size, anchor[some], how.length)
            first = np.flatnonzero(new)
            owner = doc[some][segment]
            least = np.minimum.reduceat(owner, first)
            several = (np.maximum.reduceat(owner, first) != least) | np.logical_or.reduceat(many[some][segment], first)
            at = place[first[several]]
            made.append((_text.spans_hash(own, at, at + how.length), least[several], _check(own, at, how.length)))
        del parts, text, seed, bucket, order  # what is found may be as large again
        hashed = np.concatenate([m[0] for m in made])
        order = np.argsort(hashed)
        _save_keys(folder, "strings", shard, hashed[order])
        del hashed
        _save(f"{folder}/checks-{shard}.npy", np.concatenate([m[2] for m in made])[order])
        least = np.concatenate([m[1] for m in made])
        del made
        least = least[order]
        _save(f"{folder}/least-{shard}.npy", least.astype(np.int64 if len(least) and (least.max() >= 1 << 31 or least.min() < 0) else np.int32))
        _text.release()
        return pa.table({"n": pa.array([len(order)])})

    n_hot = documents.mapInArrow(seeds, "shard int, blob binary").groupBy("shard").applyInArrow(shared_seeds, "n long").agg(F.sum("n")).first()[0]
    found = replace(found, hot=bool(n_hot))
    documents.mapInArrow(gather, "shard int, blob binary").groupBy("shard").applyInArrow(sort, "n long").agg(F.sum("n")).collect()
    return found


def covered(column: pa.Array, ids: np.ndarray, found: Found) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end row, bytes, offsets of slices of the texts, and which bytes go."""
    maps, how = _maps(found), found.how
    for group in _groups(column, ids, found):
        n_places = np.cumsum([int((piece.end - piece.first).sum()) for piece in group])
        lo = 0
        while lo < len(group):  # about LOOK places at once, however many of the bytes repeat
            hi = max(lo + 1, int(np.searchsorted(n_places, (n_places[lo - 1] if lo else 0) + LOOK, "right")))
            yield from _covered(group[lo:hi], maps, found, how)
            group[lo:hi] = [None] * (hi - lo)
            lo = hi


def _covered(group: list[_Piece], maps: _Maps, found: Found, how: Repeats) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """covered() of some slices, whose strings are looked up together."""
    looked = []
    for piece in group:
        n = piece.end - piece.first
        place = np.repeat(piece.first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hashed, at = _text.spans_hash(piece.data, place, place + how.length), np.repeat(piece.shard, n)
        if found.hot:
            at = np.where(np.repeat(piece.hot, n), _spread(hashed, found.shards), at)
        looked.append((place, hashed, at))
    least, check = maps.look_up("strings", np.concatenate([x[2] for x in looked]), np.concatenate([x[1] for x in looked]), "least", "checks")
    begin = 0
    for piece, (place, _, _) in zip(group, looked, strict=True):
        own = slice(begin, begin + len(place))
        begin += len(place)
        gone = np.flatnonzero(least[own] < piece.doc(place))
        place, known = place[gone], check[own][gone]
        place = place[known == _check(piece.data, place, how.length)]
        edges = np.zeros(len(piece.data) + 1, np.int32)
        edges[place] += 1  # each place once
        edges[place + how.length] -= 1
        yield piece.lo, piece.hi, piece.data, piece.offsets, np.cumsum(edges[:-1]) > 0


def measure(documents: DataFrame, how: Repeats | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document's whole text as UTF-8 bytes.

    A null text is empty.  Documents with the same doc_id don't cut each other; a
    null doc_id counts as the largest.  A very long text is a slice of its own, read
    whole; its memory is about 60 times its bytes.  Columns beside doc_id and text are
    not read.  An empty table gives no rows.
    """
    found = find(documents, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0))
            for lo, hi, data, offsets, gone in covered(batch.column(1), ids, found):
                starts, ends, rows = _text.runs(gone, offsets)
                removed = np.bincount(rows, ends - starts, hi - lo).astype(np.int64)
                left = data[~gone].tobytes()
                size = np.diff(offsets)
                places = np.concatenate(([0], np.cumsum(size - removed))).tolist()
                shas = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(removed), pa.array(_text.counts(rows, hi - lo)), pa.array(shas)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(documents: DataFrame, how: Repeats | None = None) -> DataFrame:
    """The documents with the repeated bytes cut from text and, where there is one, n_chars set to match.

    Bytes of a character that was cut through go too.  Documents of which nothing
    but white space is left go; texts that were null or blank before stay.  Repeated
    doc_ids, null ones and very long texts: as in measure().  All columns come back,
    whatever their names; an empty table gives no rows.
    """
    found = find(documents, how)
    schema = documents.schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = batch.column(names.index("text")), _ids(batch.column(names.index("doc_id")))
            out: list[str | None] = []
            for _, _, data, offsets, gone in covered(text, ids, found):
                left, places = data[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[offsets].tolist()
                out += [left[a:b].decode("utf-8", "ignore") for a, b in zip(places[:-1], places[1:], strict=True)]
            old = text.to_pylist()
            new = [None if o is None else n for o, n in zip(old, out, strict=True)]
            keep = [o is None or n == o or bool(n.strip()) for o, n in zip(old, new, strict=True)]
            columns = []
            for i, name in enumerate(names):
                if name == "text":
                    columns.append(pa.array(new, batch.schema.field(i).type))
                elif name == "n_chars":
                    columns.append(pa.array([c if n == o else len(n) for c, n, o in zip(batch.column(i).to_pylist(), new, old, strict=True)], batch.schema.field(i).type))
                else:
                    columns.append(batch.column(i))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
        _text.release()

    return documents.mapInArrow(run, schema)
