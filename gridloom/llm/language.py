"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams.  A document's own
most frequent n-grams are compared to each profile by out-of-place distance: the
sum of rank differences, with the profile's length for n-grams that it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _text

#: n-grams of 1 to ORDERS characters; ranks kept for a document and for a profile.
ORDERS, TOP = 3, 300
_U = np.uint64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for other characters; built once a worker."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def grams(data: np.ndarray, offsets: np.ndarray, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, has letters) hashes: rows and 44-bit n-gram keys of all n-grams of letters and word edges of each text.

    Runs of other characters count as one word edge.  An n-gram keeps to one text.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    starts = np.concatenate(([0], np.cumsum(lead)))[offsets]
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(starts))
    c = _letter_table()[points[: len(rows)]]
    begins = np.zeros(len(c), bool)
    begins[starts[:-1][starts[:-1] < len(c)]] = True
    keep = c != 0
    edge = ~keep
    edge[1:] &= keep[:-1] & ~begins[1:]
    if len(edge):
        edge[0] = False
    edge &= ~begins
    at = np.flatnonzero(keep | edge)
    c, rows = c[at].astype(_U), rows[at]
    with_letters = _text.counts(rows, len(offsets) - 1) > 0
    all_keys, all_rows, key = [], [], c
    for n in range(1, orders + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        if n > 1:
            key = key[:m] << _U(21)
            key |= c[n - 1 :]
        hashed = key * _U(0x9E3779B97F4A7C15)
        hashed ^= hashed >> _U(29)
        hashed *= _U(0xBF58476D1CE4E5B9 + 2 * n)
        hashed >>= _U(20)
        ok = rows[:m] == rows[n - 1 :] if n > 1 else c != 0
        all_keys.append(hashed[ok])
        all_rows.append(rows[:m][ok])
    if not all_keys:
        return np.zeros(0, np.int64), np.zeros(0, _U), with_letters
    return np.concatenate(all_rows), np.concatenate(all_keys), with_letters


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and count of each distinct (row, key); at most 2**20 rows, keys of 44 bits."""
    both = np.sort((rows.astype(_U) << _U(44)) | keys)
    edge = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(both)))
    return (both[edge] >> _U(44)).astype(np.int64), both[edge] & _U((1 << 44) - 1), count


def train_profiles(documents: DataFrame, orders: int = ORDERS, top: int = TOP) -> DataFrame:
    """lang, gram (44-bit key), rank (from 0) of each language's `top` n-grams, over all of documents' whole texts.

    Rows with a null text or lang teach nothing.  Tasks add up their own counts
    before the shuffle, so that a hot language sends one row a task and n-gram.
    Ties go to the smaller key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merged(a, b):
            keys, which = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
            return keys, np.bincount(which, np.concatenate((a[1], b[1]))).astype(np.int64)

        for batch in batches:
            names = batch.column(1).dictionary_encode()
            langs, codes = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in _text.slices(batch.column(0)):
                rows, keys, _ = grams(data, offsets, orders)
                lang, key, n = _distinct(codes[lo:hi][rows].astype(np.int64), keys)
                for i in np.unique(lang).tolist():
                    part = key[lang == i], n[lang == i]
                    sums[langs[i]] = merged(sums[langs[i]], part) if langs[i] in sums else part
        for name, (key, n) in sums.items():
            for i in range(0, len(key), 1 << 16):
                k = key[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.astype(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["lang", "gram", "n"])

    pairs = documents.filter("text is not null and lang is not null").select("text", "lang")
    totals = pairs.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first cut is by slices of the key, so that no language is ranked whole in one task
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(16))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = totals.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= top)
    return best.withColumn("rank", F.row_number().over(whole) - 1).filter(F.col("rank") < top).select("lang", "gram", "rank")


def _predictor(profiles: dict[str, tuple[np.ndarray, np.ndarray]], orders: int, top: int):
    langs = sorted(profiles)

    def predict(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        rows, keys, letters = grams(data, offsets, orders)
        row, key, count = _distinct(rows, keys)
        # the rank of each n-gram in its document: by count, ties by key
        order = np.lexsort((key, -count, row))
        row, key = row[order], key[order]
        begin = np.searchsorted(row, np.arange(n))
        rank = np.arange(len(row)) - begin[row]
        kept = rank < top
        row, key, rank = row[kept], key[kept], rank[kept]
        used = np.maximum(np.bincount(row, minlength=n), 1)
        far = np.full((max(len(langs), 1), n), np.inf)
        for i, lang in enumerate(langs):
            known, places = profiles[lang]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            out = np.where(known[at] == key, np.abs(places[at] - rank), top)
            far[i] = np.bincount(row, out, n) / used
        best = np.argmin(far, axis=0)
        names = [langs[b] if ok and langs else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        score = np.where(letters & (len(langs) > 0), 1 - np.min(far, axis=0) / top, 0.0) if langs else np.zeros(n)
        return names, np.clip(score, 0, 1)

    return predict


def identify(documents: DataFrame, profiles: DataFrame, orders: int = ORDERS, top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score (1 - mean out-of-place distance / longest) of each whole text.

    Texts that are null or have no letter get 'und' and score 0, as do all texts
    where no language was learned.  Equal distances go to the smaller language
    name.  The profiles, `top` rows a language, go to all tasks: their size is
    bounded by the number of languages.  Every row is judged alone, repeats alike, and
    whole, however long its text; an empty table gives no rows; columns beside doc_id
    and text are not read.
    """
    rows = profiles.select("lang", "gram", "rank").collect()
    tables = {}
    for lang in {r["lang"] for r in rows}:
        own = sorted((r["gram"], r["rank"]) for r in rows if r["lang"] == lang)
        tables[lang] = np.array([g for g, _ in own], _U), np.array([r for _, r in own], np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(tables, orders, top)
        for batch in batches:
            for lo, hi, data, offsets in _text.slices(batch.column(1)):
                names, score = predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")
