"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled into two transducers.  The normaliser rewrites characters by
longest match, squeezes and escapes spaces.  The piece transducer is a trie over all
pieces as one sorted array of (state, character) arcs; at a piece's last state it
writes the piece's number, with a weight, and returns to the root.  Characters
outside all pieces leave through byte fallback arcs.

Composing it with an input gives the input's lattice: one arc for each piece that
stands at each place.  The encoding is the lattice's shortest path in the tropical
semiring (least sum of weights).  In a unigram model an arc weighs the piece's
negative log probability.  In a model that merges pairs by rank, states also hold the
last piece: going on with another weighs 0 if merging both texts together leaves
exactly these two, else infinity, so that one path of finite weight is left.

All distinct segments of a slice are composed and searched side by side, place by
place; a segment that no arc spans is cut there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_INFINITE = float("inf")
_UNIGRAM, _MERGES = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
#: Fixed value: how far an unknown character's score lies below the least of a unigram model's.
UNKNOWN_PENALTY = 10.0
#: Texts' bytes looked at together; bytes of remembered segments, and remembered pairs, beyond which all are forgotten.
SLICE, REMEMBERED, PAIRS = 1 << 20, 32 << 20, 1 << 19


class Normaliser:
    """The model's rewriting of characters: a trie in one array, whose leaves name replacements; the longest match counts."""

    def __init__(self, spec):
        blob = spec.precompiled_charsmap
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist()
        self.outputs = blob[4 + size :]
        self.inert: dict[str, bool] = {}

    def _longest(self, key: bytes) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that key begins with."""
        units, found = self.units, None
        at = units[0] >> 10 << ((units[0] & 512) >> 6)
        for n, byte in enumerate(key, 1):
            unit = units[at ^ byte]
            if unit & 0x800000FF != byte:
                break
            at ^= byte ^ (unit >> 10 << ((unit & 512) >> 6))
            if unit & 256:
                begin = units[at] & 0x7FFFFFFF
                found = n, self.outputs[begin : self.outputs.index(0, begin)]
        return found

    def _is_inert(self, c: str) -> bool:
        """Whether no rule begins with the character."""
        if c not in self.inert:
            at, key = self.units[0] >> 10 << ((self.units[0] & 512) >> 6), c.encode("utf-8", "surrogatepass")
            for byte in key:
                unit = self.units[at ^ byte]
                if unit & 0x800000FF != byte:
                    self.inert[c] = True
                    break
                at ^= byte ^ (unit >> 10 << ((unit & 512) >> 6))
            else:
                self.inert[c] = False
        return self.inert[c]

    def rewrite(self, text: str) -> str:
        if not self.units or all(map(self._is_inert, set(text))):
            return text
        out, raw, at = bytearray(), text.encode("utf-8", "surrogatepass"), 0
        while at < len(raw):
            hit = self._longest(raw[at : at + 64])
            if hit:
                out += hit[1]
                at += hit[0]
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out += raw[at : at + n]
                at += n
        return out.decode("utf-8", "replace")


class Transducer:
    """One model's compiled encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.merges = model.trainer_spec.model_type == _MERGES
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type not in (_UNIGRAM, _MERGES) or not model.normalizer_spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or (self.merges and _USER in kinds):
            raise ValueError(f"{path}: unigram and merge models are supported, with spaces escaped and before words, merge models without user-defined pieces")
        self.normaliser = Normaliser(model.normalizer_spec)
        self.texts = [p.piece for p in model.pieces]
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN), 0)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type not in (_NORMAL, _USER, _BYTE)}
        spoken = [i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)]
        self.rank = {self.texts[i]: -model.pieces[i].score for i in spoken}
        self._compile(model, spoken)
        inside = any(SPACE in self.texts[i].lstrip(SPACE) for i in spoken)
        #: Bytes that stand alone, as no piece of several characters holds them; None: texts are not cut at all.
        self.alone = None if inside or (SPACE not in self.rank and not self.bytes) else np.array([b < 0x20 and bool(self.bytes) and not any(chr(b) in self.texts[i] and len(self.texts[i]) > 1 for i in spoken) for b in range(256)])
        self.spines: dict[int, tuple] = {}
        self.forget()

    def _compile(self, model, spoken: list[int]) -> None:
        """The trie's arcs, final states and weights.  A character that only longer pieces hold gets a number of its own behind the pieces'."""
        known = {self.texts[i] for i in spoken}
        self.extra = sorted({c for t in known for c in t} - known)
        names = [(self.texts[i], i) for i in spoken] + [(c, len(self.texts) + k) for k, c in enumerate(self.extra)]
        arcs: dict[int, int] = {}
        final = [-1]
        for text, number in names:
            state = 0
            for c in text:
                key = state << 21 | ord(c)
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(-1)
                state = arcs[key]
            final[state] = number
        keys = np.fromiter(arcs, np.int64, len(arcs))
        order = np.argsort(keys)
        self.arc_key, self.arc_to = keys[order], np.fromiter(arcs.values(), np.int64, len(arcs))[order]
        self.final = np.array(final)
        self.weight = np.zeros(len(self.texts) + len(self.extra) + 1, np.float32)  # the last one is byte fallback's
        if not self.merges:
            scores = [model.pieces[i].score for i in spoken if model.pieces[i].type == _NORMAL] or [0.0]
            for i in spoken:
                p = model.pieces[i]
                self.weight[i] = -(len(p.piece.encode()) * max(scores) - 0.1 if p.type == _USER else p.score)
            self.weight[len(self.texts) :] = -np.float32(min(scores) - UNKNOWN_PENALTY)
        self.fallback = len(self.weight) - 1
        self.sound = np.full(len(self.weight), 1 if not self.merges else -1, np.int8)
        self.sound[self.fallback] = 1
        self.pair_key, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.n_ids, self.first, self.n_bytes, self.same = [np.zeros(1 << 10, t) for t in (np.int32, np.int64, np.int64, np.int64, bool)]
        self.used = 0

    # the weights of a merge model

    def _name(self, number: int) -> str:
        return self.texts[number] if number < len(self.texts) else self.extra[number - len(self.texts)]

    def _spine(self, number: int) -> tuple:
        """All merges of a piece's characters, best rank and leftmost first: what is left, and the left and right edges' (text, rank) in turn."""
        found = self.spines.get(number)
        if found is None:
            text, rank = self._name(number), self.rank
            parts, left, right = list(text), [(text[0], 0.0)], [(text[-1], 0.0)]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], _INFINITE))
                joined = parts[best] + parts[best + 1]
                if joined not in rank:
                    break
                if best == 0:
                    left.append((joined, rank[joined]))
                if best == len(parts) - 2:
                    right.append((joined, rank[joined]))
                parts[best : best + 2] = [joined]
            found = self.spines[number] = parts, left, right
        return found

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the text a + b leaves exactly a and b.

        Both sides grow towards the border; a merge across it happens when its
        rank is ahead of the next merge on either side (equal ranks: the left one first).
        """
        r, l = self._spine(a)[2], self._spine(b)[1]
        i = j = 0
        while True:
            across = self.rank.get(r[i][0] + l[j][0], _INFINITE)
            next_r = r[i + 1][1] if i + 1 < len(r) else _INFINITE
            next_l = l[j + 1][1] if j + 1 < len(l) else _INFINITE
            if across < next_r and across <= next_l and across < _INFINITE:
                return False
            if next_r == next_l == _INFINITE:
                return True
            if next_r <= next_l:
                i += 1
            else:
                j += 1

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_fit of many pairs; pairs seen stay in a sorted array."""
        width = len(self.weight)
        key, back = np.unique(a * width + b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_key, key), max(len(self.pair_key) - 1, 0))
        have = self.pair_key[at] == key if len(self.pair_key) else np.zeros(len(key), bool)
        out = np.zeros(len(key), bool)
        out[have] = self.pair_fits[at[have]] if have.any() else False
        new = key[~have]
        if len(new):
            fresh = np.fromiter((x == self.fallback or y == self.fallback or self._fit(x, y) for x, y in zip((new // width).tolist(), (new % width).tolist(), strict=True)), bool, len(new))
            out[~have] = fresh
            if len(self.pair_key) > PAIRS:
                self.pair_key, self.pair_fits = new, fresh
            else:
                keys, flags = np.concatenate((self.pair_key, new)), np.concatenate((self.pair_fits, fresh))
                order = np.argsort(keys, kind="stable")
                self.pair_key, self.pair_fits = keys[order], flags[order]
        return out[back]

    def _sound(self, pieces: np.ndarray) -> np.ndarray:
        """Whether a piece is what merging its own characters leaves; always so in a unigram model."""
        for p in np.unique(pieces[self.sound[pieces] < 0]).tolist():
            self.sound[p] = len(self._spine(p)[0]) == 1
        return self.sound[pieces] > 0

    # composition and search

    def compose(self, points: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lattice of segments of code points: start, end and piece of every arc; stops: where the segment of each place ends."""
        start, state, k = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        starts, ends, pieces = [], [], []
        alone = np.ones(len(points), bool)
        while len(start):
            live = start + k < stops[start]
            start, state = start[live], state[live]
            key = state << 21 | points[start + k]
            at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            on = self.arc_key[at] == key
            start, state, k = start[on], self.arc_to[at[on]], k + 1
            piece = self.final[state]
            done = piece >= 0
            if k == 1:
                alone[start[done]] = False
            starts.append(start[done]), ends.append(start[done] + k), pieces.append(piece[done])
        lost = np.flatnonzero(alone)
        start, end, piece = np.concatenate([*starts, lost]), np.concatenate([*ends, lost + 1]), np.concatenate([*pieces, np.full(len(lost), self.fallback)])
        sound = self._sound(piece)
        return start[sound], end[sound], piece[sound]

    def shortest(self, n: int, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The arcs on the lattice's shortest paths over all n places, in order; ties to the longer last arc."""
        # where no arc spans a place, the lattice falls apart
        spanned = np.zeros(n + 1, np.int64)
        wide = end - start > 1
        np.add.at(spanned, start[wide] + 1, 1)
        np.add.at(spanned, end[wide], -1)
        begins = np.cumsum(spanned[:n]) == 0
        begin = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        depth = end - begin[start]
        order = np.lexsort((start, end, depth))
        edge = np.flatnonzero(np.concatenate(([True], depth[order][1:] != depth[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        best, last = np.full(n, np.float32(np.inf), np.float32), np.full(n, -1)  # of the path that ends behind each place
        for i, j in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist(), strict=True):
            arcs = order[i:j]
            s, e, p = start[arcs], end[arcs], piece[arcs]
            fresh = begins[s]
            cost = np.where(fresh, np.float32(0), best[s - 1]) + self.weight[p]
            if self.merges:
                again = np.flatnonzero(~fresh & (cost < np.inf))
                if len(again):
                    cost[again[~self._fits(piece[last[s[again] - 1]], p[again])]] = np.inf
            group = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            least = np.minimum.reduceat(cost, group)
            hit = np.flatnonzero((cost == np.repeat(least, np.diff(np.append(group, len(e))))) & (cost < np.inf))
            hit = hit[np.concatenate(([True], e[hit][1:] != e[hit][:-1]))] if len(hit) else hit
            best[e[hit] - 1], last[e[hit] - 1] = cost[hit], arcs[hit]
        # back from each part's end
        at = np.append(np.flatnonzero(begins)[1:], n) if n else np.zeros(0, np.int64)
        path = []
        while len(at):
            arcs = last[at - 1]
            path.append(arcs)
            at = start[arcs]
            at = at[~begins[at]]
        found = np.concatenate(path) if path else np.zeros(0, np.int64)
        return found[np.argsort(start[found])]

    def _remember(self, segments: list[bytes]) -> None:
        """Encodes segments and keeps their numbers."""
        texts = [s.decode("utf-8", "surrogatepass").replace(" ", SPACE) for s in segments]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        start, end, piece = self.compose(points, np.repeat(ends, sizes))
        path = self.shortest(len(points), start, end, piece)
        place, number = start[path], piece[path]
        owner = np.searchsorted(ends, place, "right")
        plain = number < len(self.texts)
        count = np.ones(len(path), np.int64)
        spelled = {}
        for k in np.flatnonzero(~plain).tolist():
            if self.bytes:
                spelled[k] = [self.bytes[b] for b in chr(points[place[k]]).encode("utf-8", "surrogatepass")]
                count[k] = len(spelled[k])
            elif k and not plain[k - 1] and owner[k] == owner[k - 1]:
                count[k] = 0  # a run of unknown characters is one unknown piece
            else:
                number[k] = self.unknown
        to = np.cumsum(count) - count
        ids = np.repeat(np.where(plain | (count == 1), number, 0), count).astype(np.int32)
        for k, own in spelled.items():
            ids[to[k] : to[k] + count[k]] = own
        n_ids = np.bincount(owner, count, len(texts)).astype(np.int64)
        n_bytes = np.bincount(owner, np.where(plain, 0, count) if self.bytes else np.zeros(len(path)), len(texts)).astype(np.int64)
        first = np.cumsum(n_ids) - n_ids
        same = np.array([self._plain(ids[a : a + k].tolist()) == t.replace(SPACE, " ") for a, k, t in zip(first.tolist(), n_ids.tolist(), texts, strict=True)], bool)
        slot = len(self.slots)
        self.slots.update((s, slot + k) for k, s in enumerate(segments))
        self.ids = _put(self.ids, self.used, ids)
        self.n_ids, self.first, self.n_bytes, self.same = (_put(a, slot, b) for a, b in ((self.n_ids, n_ids), (self.first, self.used + first), (self.n_bytes, n_bytes), (self.same, same)))
        self.used += len(ids)
        self.held += 4 * len(ids) + sum(map(len, segments)) + 160 * len(segments)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and for each text their number, the number of byte ids and whether decoding them gives the text again."""
        n = len(offsets) - 1
        norm, same = self.normaliser, np.ones(n, bool)
        if norm.units:
            raw = data.tobytes()
            old = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            new = [norm.rewrite(t.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass") for t in old]
            same = np.array([a == b for a, b in zip(old, new, strict=True)], bool)
            data, offsets = np.frombuffer(b"".join(new), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, new))))).astype(np.int64)
        if norm.squeeze:
            space = data == 0x20
            after = np.concatenate(([False], space[:-1]))
            after[offsets[:-1][offsets[:-1] < len(data)]] = True  # spaces at a text's beginning go
            gone = space & after
            starts, ends, rows = _text.runs(space, offsets)
            for a in starts[ends == offsets[rows + 1]].tolist():  # and those at its end
                gone[a] = True
            gone = np.flatnonzero(gone)
            same[np.searchsorted(offsets, gone, "right") - 1] = False
            data, offsets = _without(data, offsets, gone)
        # the escaping sign is a space already
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(sign):
            same[np.searchsorted(offsets, sign, "right") - 1] = False
            data = data.copy()
            data[sign] = 0x20
            data, offsets = _without(data, offsets, np.concatenate((sign + 1, sign + 2)))
            if norm.squeeze:  # one at a text's end goes like a space
                starts, ends, rows = _text.runs(data == 0x20, offsets)
                last = ends == offsets[rows + 1]
                data, offsets = _without(data, offsets, np.concatenate([np.arange(a, b) for a, b in zip(starts[last], ends[last], strict=True)] or [np.zeros(0, np.int64)]))
        if norm.prefix:
            some = np.flatnonzero(np.diff(offsets) > 0)
            data = np.insert(data, offsets[some], 0x20)
            offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        new = np.zeros(len(data), bool)
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.alone is not None and len(data):
            space, alone = data == 0x20, self.alone[data]
            new[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        _, first, which = np.unique(_text.spans_hash(data, begin, end), return_index=True, return_inverse=True)
        if self.held > REMEMBERED:
            self.forget()
        raw = data.tobytes()
        segments = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        lost = [s for s in segments if s not in self.slots]
        if lost:
            self._remember(lost)
        slot = np.fromiter(map(self.slots.__getitem__, segments), np.int64, len(segments))[which]
        row = np.searchsorted(offsets, begin, "right") - 1
        size = self.n_ids[slot]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.repeat(self.first[slot] - (upto - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
        same[row[~self.same[slot]]] = False
        return ids, np.bincount(row, size, n).astype(np.int64), np.bincount(row, self.n_bytes[slot], n).astype(np.int64), same

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_slice(raw, np.array([0, len(raw)]))[0].tolist()

    # decoding

    def _plain(self, ids: list[int]) -> str:
        """Pieces to text, runs of byte pieces as UTF-8 (a byte outside any character as U+FFFD), spaces back."""
        out, run, texts, byte_of = [], bytearray(), self.texts, self.byte_of
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.silent:
                out.append(texts[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: _plain without the space that the normaliser puts first."""
        text = self._plain(ids)
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text


def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """held with `more` from place `at` on, in a larger array if need be."""
    if at + len(more) > len(held):
        held = np.concatenate((held[:at], np.zeros(max(at, len(more)) + len(more), held.dtype)))
    held[at : at + len(more)] = more
    return held


def _without(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without the bytes at `gone`."""
    stay = np.ones(len(data), bool)
    stay[gone] = False
    return data[stay], np.concatenate(([0], np.cumsum(stay)))[offsets]


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled model, kept while the worker lives."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(documents: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte fallback), ids, round_trip (decoding gives the text again) of each whole text, and the columns of `keep`.

    A null text has null ids and round_trip, an empty one no ids.  Texts that hold
    U+2581 itself encode as the model does and decode to spaces: round_trip is
    false, as it is where the normaliser changed the text.  Each row is encoded alone,
    without a shuffle: rows that repeat are encoded alike, and columns beside doc_id
    and text, whatever their names, are not read.  A very long text is a slice of its
    own; one without spaces is cut only where no piece spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in _text.slices(batch.column(1), SLICE):
                ids, n_ids, n_bytes, same = t.encode_slice(data, offsets)
                null = pa.array(missing[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_ids))).astype(np.int32)), pa.array(ids), mask=null)
                kept = [batch.column(2 + k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_ids), pa.array(n_bytes), lists, pa.array(same, mask=missing[lo:hi]), *kept], names=["doc_id", "n_ids", "n_bytes", "ids", "round_trip", *keep])
        t.forget()  # the worker goes on to other tasks, of other stages too
        t.spines.clear()
        _text.release()

    more = "".join(f", `{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select("doc_id", "text", *keep).mapInArrow(run, "doc_id long, n_ids long, n_bytes long, ids array<int>, round_trip boolean" + more)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of (doc_id, ids): the inverse of encode; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
