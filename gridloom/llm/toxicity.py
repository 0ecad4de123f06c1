"""Toxicity by Levenshtein automata over a learned lexicon trie, with context windows.

The lexicon is learned: words, and word beginnings (open entries), that labelled
toxic documents hold and clean ones do not.  Its trie is intersected with the
Levenshtein automaton of distance 1, in which two neighbouring letters that change
places are one edit too (sets of (trie node, edits, letter still to come) states, made
deterministic once), and all distinct words of a slice run through the result
together.  Each hit is weighed by what hits of its kind (exact or misspelled,
quoted or not, by term) meant in the labelled documents.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _text
from gridloom.llm._store import written

#: Signs trimmed from a word's ends before it is looked up; quotation opens and closes with these.
TRIM = " \t\n\r\v\f.,;:!?()[]{}<>*_~|\"'`«»„“”‚‘’…-"
QUOTES = "\"«»„“”>"
#: Words that say that someone else is cited, in the windows beside a hit.
REPORTS = ("said", "says", "called", "wrote", "quote", "quoted", "word", "term", "sagte", "schrieb", "wort", "zitat", "dit", "écrit", "mot", "terme", "dijo", "escribió", "palabra", "término")


@dataclass(frozen=True)
class Lexicon:
    """Learning: at most `sample` labelled documents, chosen by hash of doc_id (a documented bound on the classifier's sample);
    entries whose smoothed share of toxic documents is `purity` and whose counts chance explains with probability `chance` at most, whatever the sample's size;
    word beginnings of `prefix` to `prefix_to` letters are entries too.  The sample alone bounds the entries' number.
    Matching: terms of at least `fuzzy` letters also match at distance 1; windows of `window` words."""

    sample: int = 20_000
    chance: float = 0.005
    purity: float = 0.8
    prefix: int = 4
    prefix_to: int = 7
    fuzzy: int = 5
    window: int = 8


class Matcher:
    """The deterministic intersection of the lexicon's trie with the Levenshtein automaton.

    terms: (text, open) pairs; an open term matches every word that begins with it,
    exactly.  A hit is a term's number times 2, plus 1 if misspelled.
    """

    def __init__(self, terms: list[tuple[str, bool]], fuzzy: int):
        self.terms = terms
        nodes: list[dict[str, int]] = [{}]
        closed: dict[int, int] = {}
        opened: dict[int, int] = {}
        for number, (text, is_open) in enumerate(terms):
            at = 0
            for c in text:
                if c not in nodes[at]:
                    nodes.append({})
                    nodes[at][c] = len(nodes) - 1
                at = nodes[at][c]
            (opened if is_open else closed)[at] = number
        # a node may spend an edit only on the way to a closed term long enough for one
        deep = [False] * len(nodes)
        for number, (text, is_open) in enumerate(terms):
            if not is_open and len(text) >= fuzzy:
                at = 0
                deep[0] = True
                for c in text:
                    at = nodes[at][c]
                    deep[at] = True
        letters = sorted({c for text, _ in terms for c in text})
        self.column = np.zeros(0x110000, np.int32)  # 0: a letter outside the lexicon
        for i, c in enumerate(letters):
            self.column[ord(c)] = i + 1

        def close(states: set[tuple[int, int, str]]) -> frozenset:
            """With the lexicon's letters that the word may lack."""
            more = set(states)
            for node, edits, _ in states:
                if edits == 0:
                    more.update((child, 1, "") for child in nodes[node].values() if deep[child])
            return frozenset(more)

        def step(states: frozenset, c: str | None) -> frozenset:
            out: set[tuple[int, int, str]] = set()
            for node, edits, owed in states:
                if owed:  # the second of two letters that change places
                    if c == owed:
                        out.add((node, 1, ""))
                    continue
                if c is not None and c in nodes[node]:
                    out.add((nodes[node][c], edits, ""))
                if edits == 0 and deep[node]:
                    out.add((node, 1, ""))
                    out.update((child, 1, "") for child in nodes[node].values() if deep[child])
                    if c is not None:
                        out.update((nodes[child][c], 1, first) for first, child in nodes[node].items() if first != c and c in nodes[child] and deep[nodes[child][c]])
            return close(out)

        def hit(states: frozenset) -> int:
            exact = [closed[n] for n, e, _ in states if e == 0 and n in closed]
            close_by = [closed[n] for n, e, owed in states if e == 1 and not owed and n in closed and len(terms[closed[n]][0]) >= fuzzy]
            return 2 * min(exact) if exact else 2 * min(close_by) + 1 if close_by else -1

        start = close({(0, 0, "")})
        number = {start: 0}
        place = {c: i + 1 for i, c in enumerate(letters)}
        rows, hits, reached, queue = [], [], [], deque([start])
        while queue:
            states = queue.popleft()
            # letters that no state goes on with act as one outside the lexicon
            on = {c for node, _, owed in states for c in ([owed] if owed else nodes[node])}
            on |= {c for node, edits, owed in states if edits == 0 and not owed and deep[node] for child in nodes[node].values() for c in nodes[child]}
            row = [0] * (len(letters) + 1)
            for c in [None, *sorted(on)]:
                to = step(states, c)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                if c is None:
                    row = [number[to]] * (len(letters) + 1)
                else:
                    row[place[c]] = number[to]
            rows.append(row)
            hits.append(hit(states))
            begun = [opened[n] for n, e, _ in states if e == 0 and n in opened]
            reached.append(2 * min(begun) if begun else -1)
        self.table, self.hits, self.reached = np.array(rows, np.int32), np.array(hits, np.int32), np.array(reached, np.int32)

    def match(self, words: list[str]) -> np.ndarray:
        """Each word's hit, or -1; all words run through the automaton side by side."""
        n = len(words)
        out = np.full(n, -1, np.int32)
        if not n or not self.terms:
            return out
        sizes = np.fromiter(map(len, words), np.int64, n)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        columns = self.column[points]
        begins = np.cumsum(sizes) - sizes
        live, state = np.flatnonzero(sizes > 0), np.zeros(n, np.int32)
        k = 0
        while len(live):
            state[live] = self.table[state[live], columns[begins[live] + k]]
            got = self.reached[state[live]]
            out[live] = np.where(out[live] < 0, got, out[live])
            k += 1
            ended = live[sizes[live] == k]
            final = self.hits[state[ended]]
            out[ended] = np.where((final >= 0) & ((out[ended] < 0) | (final % 2 == 0)), final, out[ended])
            live = live[sizes[live] > k]
            live = live[(out[live] >= 0) | (state[live] != self._dead())]
        return out

    def _dead(self) -> int:
        if not hasattr(self, "_none"):
            dead = [i for i in range(len(self.table)) if self.hits[i] < 0 and self.reached[i] < 0 and (self.table[i] == i).all()]
            self._none = dead[0] if dead else -1
        return self._none


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Row and distinct-word number of each word; the distinct words trimmed and lower-cased; whether one opens or ends a quotation."""
    starts, ends, rows = _text.words(data, offsets)
    hashes = _text.spans_hash(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    shown = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    trimmed = [w.strip(TRIM).lower() for w in shown]
    opens = np.fromiter((w[0] in QUOTES for w in shown), bool, len(shown))
    shuts = np.fromiter((w.rstrip(".,;:!?)")[-1:] in QUOTES if w.rstrip(".,;:!?)") else False for w in shown), bool, len(shown))
    return rows, which, trimmed, opens, shuts


def _quoted(rows: np.ndarray, at: np.ndarray, opens: np.ndarray, shuts: np.ndarray, reports: np.ndarray, window: int) -> np.ndarray:
    """Whether each hit's windows show quotation: an opening sign before and a closing one after it, or a reporting word with one of them."""
    n = len(rows)
    before = np.zeros(len(at), bool)
    after, told = before.copy(), before.copy()
    for k in range(window + 1):
        i = at - k
        ok = (i >= 0) & (rows[np.maximum(i, 0)] == rows[at])
        before |= ok & opens[np.maximum(i, 0)]
        told |= ok & reports[np.maximum(i, 0)]
        i = np.minimum(at + k, n - 1)
        ok = rows[i] == rows[at]
        after |= ok & shuts[i]
        told |= ok & reports[i]
    return (before & after) | (told & (before | after))


def hits(data: np.ndarray, offsets: np.ndarray, matcher: Matcher, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and kind (term hit * 2 + quoted) of each hit of a slice."""
    rows, which, words, opens, shuts = _words(data, offsets)
    found = matcher.match(words)
    reports = np.fromiter((w in REPORTS for w in words), bool, len(words))
    at = np.flatnonzero(found[which] >= 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    quoted = _quoted(rows, at, opens[which], shuts[which], reports[which], window)
    return rows[at], found[which[at]].astype(np.int64) * 2 + quoted


def without_copies(documents: DataFrame, draws: int = 3) -> DataFrame:
    """The rows (doc_id, text) but those that share a least shingle hash, in any of `draws` orders, with a smaller doc_id.

    Copies and near copies would otherwise turn one text's chance words into
    evidence.  Meant for the bounded sample that teaches the lexicon.
    """
    from gridloom.llm.neardup import shingle_sets

    names = [f"m{i}" for i in range(draws)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.slices(batch.column(1)):
                row, element, _ = shingle_sets(data, offsets, 5)
                least = np.full((draws, hi - lo), (1 << 64) - 1, np.uint64)
                for i in range(draws):
                    np.minimum.at(least[i], row, _text.mix(element + np.uint64(i)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(x.view(np.int64)) for x in least]], names=["doc_id", *names])

    kept = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
    for name in names:
        kept = kept.withColumn("first", F.min("doc_id").over(Window.partitionBy(name))).filter("doc_id = first").drop("first")
    return documents.join(kept.select("doc_id"), "doc_id", "left_semi")


def learn_terms(labelled: DataFrame, lexicon: Lexicon) -> list[tuple[str, bool]]:
    """The entries of learn_lexicon."""
    return learn_lexicon(labelled, lexicon)[0]


def learn_lexicon(labelled: DataFrame, lexicon: Lexicon) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """The lexicon of (text, toxic 0/1) rows: (entry, open) in order of evidence, and how far each is to be trusted, 0 to 1.

    Trust is 1 less the part of the entries of like counts that chance alone would
    bring, so that weak entries weigh little instead of being dropped.

    Counts documents that hold each word and word beginning; an entry that a
    shorter chosen beginning covers is left out, but for words of at least
    lexicon.fuzzy letters: beginnings match exactly only, so misspellings inside
    them are found by the whole word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in _text.slices(batch.column(0)):
                rows, which, words, _, _ = _words(data, offsets)
                keys: dict[tuple[str, bool], int] = {}
                entry: list[list[int]] = []
                for w in words:
                    own = []
                    if w:
                        own.append(keys.setdefault((w, False), len(keys)))
                        own += [keys.setdefault((w[:k], True), len(keys)) for k in range(lexicon.prefix, min(lexicon.prefix_to, len(w) - 1) + 1)]
                    entry.append(own)
                sizes = np.fromiter(map(len, entry), np.int64, len(entry))
                flat = np.fromiter((e for own in entry for e in own), np.int64, int(sizes.sum()))
                base = np.cumsum(sizes) - sizes
                per = sizes[which]
                end = np.cumsum(per)
                pick = np.repeat(base[which] - (end - per), per) + np.arange(int(per.sum()))
                pair = np.unique(np.repeat(rows, per) * max(len(keys), 1) + flat[pick])
                doc, key = pair // max(len(keys), 1), pair % max(len(keys), 1)
                n = np.bincount(key, minlength=len(keys))
                t = np.bincount(key, toxic[lo + doc], len(keys)).astype(np.int64)
                names = list(keys)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.string()), pa.array([o for _, o in names], pa.bool_()), pa.array(n), pa.array(t)], names=["term", "open", "n", "t"])

    counted = labelled.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(count, "term string, open boolean, n long, t long")
    sums = written(counted.groupBy("term", "open").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    whole = sums.agg(F.sum("t"), F.sum("n")).first()
    base = min(max((whole[0] or 0) / (whole[1] or 1), 1e-9), 1 - 1e-9)
    # n times the divergence of t / n from the share of toxic ones among all words' documents: chance reaches it with probability exp(-it) at most
    n, t = F.col("n"), F.col("t")
    far = t * F.log(t / n / base) + F.when(n > t, (n - t) * F.log((n - t) / n / (1 - base))).otherwise(0.0)
    pure = sums.filter((t / n > base) & ((t + 0.5) / (n + 1.0) >= lexicon.purity)).withColumn("far", far).filter(F.col("far") >= -float(np.log(lexicon.chance)))
    rows = pure.orderBy(F.desc("t"), "open", F.length("term"), "term").collect()  # bounded by the sample
    alike = {(r["open"], r["n"]): r["count"] for r in sums.groupBy("open", "n").count().collect()} if rows else {}
    same: dict[tuple[bool, int], list[int]] = {}
    for r in rows:
        same.setdefault((r["open"], r["n"]), []).append(r["t"])  # from most to least
    trust = {}
    for r in rows:
        of = same[r["open"], r["n"]]
        trust[r["term"], r["open"]] = max(0.0, 1 - alike[r["open"], r["n"]] * float(np.exp(-r["far"])) / sum(x >= r["t"] for x in of))
    chosen: list[tuple[str, bool]] = []
    begun: set[str] = set()
    for r in sorted(rows, key=lambda r: (not r["open"], len(r["term"]))):
        covered = any(r["term"][:k] in begun for k in range(1, len(r["term"]) + 1))
        if not covered or (not r["open"] and len(r["term"]) >= lexicon.fuzzy):
            chosen.append((r["term"], r["open"]))
            if r["open"]:
                begun.add(r["term"])
    order = {(r["term"], r["open"]): i for i, r in enumerate(rows)}
    chosen.sort(key=order.__getitem__)
    return chosen, np.array([trust[c] for c in chosen])


def learn_weights(labelled: DataFrame, matcher: Matcher, lexicon: Lexicon, trust: np.ndarray) -> tuple[np.ndarray, float]:
    """Share of toxic documents among those with a hit of each kind, and among those without any hit; both smoothed.

    A kind seen too little leans to its class: misspelled or quoted hits as such; the
    less a term is to be trusted, the nearer its kinds are to no hit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in _text.slices(batch.column(0)):
                rows, kinds = hits(data, offsets, matcher, lexicon.window)
                width = 4 * len(matcher.terms) + 1
                pair = np.unique(rows * width + kinds)
                none = np.setdiff1d(np.arange(hi - lo), rows)
                doc, kind = np.concatenate((pair // width, none)), np.concatenate((pair % width, np.full(len(none), -1)))
                kinds, at = np.unique(kind, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(np.bincount(at, minlength=len(kinds))), pa.array(np.bincount(at, toxic[lo + doc], len(kinds)).astype(np.int64))], names=["kind", "n", "t"])

    got = labelled.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(count, "kind long, n long, t long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    n, t = np.zeros(4 * len(matcher.terms)), np.zeros(4 * len(matcher.terms))
    rest = 0.02
    for r in got:
        if r["kind"] < 0:
            rest = (r["t"] + 0.2) / (r["n"] + 10.0)
        else:
            n[r["kind"]], t[r["kind"]] = r["n"], r["t"]
    prior, sure = np.zeros(4), np.repeat(trust, 4)
    for k, start in enumerate((0.9, 0.2, 0.5, 0.15)):  # exact, exact quoted, misspelled, misspelled quoted
        prior[k] = ((sure * t)[k::4].sum() + 5 * start) / ((sure * n)[k::4].sum() + 5)
    firm = np.tile(np.array([2.0, 4.0, 12.0, 12.0]), len(matcher.terms))  # a chance likeness to a term needs more evidence
    return sure * (t + firm * np.tile(prior, len(matcher.terms))) / (n + firm) + (1 - sure) * rest, rest


def score(documents: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= threshold) and n_hits of each whole text, learned from labels (doc_id, toxic).

    Only `labels` rows teach; nulls in toxic or text teach nothing.  The score is the
    share of toxic documents of the document's strongest kind of hit, so that chance
    likenesses in a long text don't add up; without a hit it is the share among
    documents without one, also for null and empty texts.  Without labels all score 0.02.
    Every row is scored alone, repeats alike, texts whole, however long; of several
    labels of one doc_id the highest counts; kinds of equal share make no difference;
    an empty table gives no rows; columns beside doc_id and text are not read.
    """
    lexicon = lexicon or Lexicon()
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = known if n <= lexicon.sample else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * lexicon.sample / n)))
    labelled = documents.select("doc_id", "text").filter("text is not null").join(part, "doc_id")
    labelled = written(without_copies(labelled).select("text", "toxic"))
    terms, trust = learn_lexicon(labelled, lexicon)
    matcher = Matcher(terms, lexicon.fuzzy)
    weights, rest = learn_weights(labelled, matcher, lexicon, trust)
    shared = documents.sparkSession.sparkContext.broadcast((matcher, weights, rest))  # bounded by lexicon.sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights, rest = shared.value
        width = 4 * len(matcher.terms) + 1
        for batch in batches:
            for lo, hi, data, offsets in _text.slices(batch.column(1)):
                rows, kinds = hits(data, offsets, matcher, lexicon.window)
                pair = np.unique(rows * width + kinds)
                doc, kind = pair // width, pair % width
                value = np.full(hi - lo, rest)
                np.maximum.at(value, doc, weights[kind])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(np.bincount(rows, minlength=hi - lo))], names=["doc_id", "score", "predicted", "n_hits"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_hits long")
