"""Importance resampling towards a target distribution, by hashed word runs.

Each feature, a run of 1 to `n` words, falls into a bucket by the CRC-32 of its
bytes.  A bucket's gain is the scaled logarithm of its share in the target over
its share in the documents; a document weighs the floored mean of its features'
gains, and Gumbel noise by its id turns the highest scores into a weighted draw
without replacement.

Long texts are skewed work.  They are cut into chunks at word boundaries; a chunk
carries the n - 1 words that follow it, so that the runs which start in its own
words are whole, and each run is counted in the one chunk that owns its start.
Chunks go to tasks of their own, and counts and weights are summed by document,
so neither time nor memory of a task follows the longest text once it is cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text
from gridloom.llm._store import written
from gridloom.operators.ids import dense_ids

#: Word bytes: 0-9, a-z, A-Z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = np.ones(256, bool)
_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


@dataclass(frozen=True)
class Resample:
    """n: longest run of words; buckets: of the hashed features; least: words of a document that may be drawn;
    percent: share of those that is drawn; seed: of the noise; chunk: bytes from which a text is cut, and of its chunks."""

    n: int = 1
    buckets: int = 10_000
    least: int = 20
    percent: int = 10
    seed: int = 2024
    chunk: int = 1 << 16

    def __post_init__(self):
        if self.n < 1 or self.chunk < 64 or not 1 <= self.buckets <= 1 << 20:
            raise ValueError("runs have a word or more, chunks 64 bytes or more, and there are 1 to 1,048,576 buckets")


def _table() -> np.ndarray:
    """CRC-32 of each single byte's step (polynomial 0xEDB88320, reflected)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _table()
#: Words that a text owns which is not cut: all of them.
_WHOLE = 1 << 62
#: Spans longer than this are hashed one by one.
_WIDE = 96


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, a byte of all spans at a time."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, _WIDE + 1), kind="stable")
    wide = int((size > _WIDE).sum())
    some = order[wide:]
    at, state = starts[some], out[some]
    n_longer = len(some) - np.cumsum(np.bincount(size[some], minlength=_WIDE + 1))  # spans with more than k bytes
    for k in range(_WIDE):
        n = int(n_longer[k])
        if not n:
            break
        s = state[:n]
        state[:n] = _STEP[(s ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out[some] = state
    out ^= np.uint32(0xFFFFFFFF)
    raw = memoryview(np.ascontiguousarray(data))
    for i in order[:wide].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return out


def features(data: np.ndarray, offsets: np.ndarray, own: np.ndarray, how: Resample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of each feature that starts in its row's own words, and the number of own words of each row.

    own: of each row, how many of its words it owns; the rest is carry.
    """
    member = _WORD[data]
    starts, ends, rows = _text.runs(member, offsets)
    lower = _text.lower_ascii(data)
    if how.n > 1:  # words one after another, a space apart
        size = ends - starts
        to = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        source = np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(to, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lower[source]
        lower, starts, ends = joined, to, to + size
    first = np.searchsorted(rows, np.arange(len(own)))
    mine = np.arange(len(rows)) - first[rows] < own[rows]
    buckets, owners = [], []
    for k in range(how.n):
        n = len(rows) - k
        if n <= 0:
            break
        at = np.flatnonzero(mine[:n] & (rows[:n] == rows[k:]))
        buckets.append(crc32(lower, starts[at], ends[at + k]) % np.uint32(how.buckets))
        owners.append(rows[at])
    words = np.minimum(np.bincount(rows, minlength=len(own)), own)
    none = np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64) if buckets else none, np.concatenate(owners) if owners else none, words


def cut(text: bytes, how: Resample) -> Iterator[tuple[bytes, int]]:
    """The chunks of a text and how many words each owns: about how.chunk bytes of own words, then the carry."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = _text.runs(_WORD[data], np.array([0, len(data)]))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + how.chunk)))
        last = min(hi + how.n - 1, len(starts))
        yield text[starts[lo] : ends[last - 1]], min(hi, len(starts)) - lo
        lo = hi


def short(documents: DataFrame, how: Resample) -> DataFrame:
    """doc_id, digest (null), part, text, own of the texts that are not cut, where they are."""
    kept = documents.filter(~F.coalesce(F.octet_length("text") > how.chunk, F.lit(False)))
    return kept.select("doc_id", F.lit(None).cast("string").alias("digest"), F.lit(0).alias("part"), "text", F.lit(_WHOLE).alias("own"))


def pieces(documents: DataFrame, how: Resample) -> DataFrame:
    """doc_id, digest, part, text, own of the chunks of the long texts, dealt out over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py().encode()
                digest = hashlib.sha256(content).hexdigest()
                for part, (piece, own) in enumerate(cut(content, how)):
                    # a piece begins and ends at a word, so it is whole UTF-8
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([digest]), pa.array([part], pa.int32()), pa.array([piece.decode()]), pa.array([own], pa.int64())], names=["doc_id", "digest", "part", "text", "own"])

    found = documents.filter(F.octet_length("text") > how.chunk).select("doc_id", "text").mapInArrow(run, "doc_id long, digest string, part int, text string, own long")
    return found.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "digest", "part")


def bucket_counts(texts: DataFrame, how: Resample | None = None) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any. A task sends one dense array."""
    how = how or Resample()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in _text.slices(batch.column(0)):
                bucket, _, _ = features(data, offsets, own[lo:hi], how)
                total += np.bincount(bucket, minlength=how.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
        _text.release()

    rows = texts.select("doc_id" if "doc_id" in texts.columns else F.lit(0).cast("long").alias("doc_id"), "text")
    both = short(rows, how).union(pieces(rows, how)).select("text", "own")
    return both.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, how: Resample | None = None) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of counts s, t and their sums S, T."""
    how = how or Resample()
    every = documents.sparkSession.range(how.buckets).withColumnRenamed("id", "bucket")
    s, t = bucket_counts(documents, how), bucket_counts(target, how)
    j = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    j = written(j)  # how.buckets rows
    all_ = j.agg((F.sum("s") + how.buckets).cast("double").alias("all_s"), (F.sum("t") + how.buckets).cast("double").alias("all_t"))
    ratio = ((F.col("t") + 1).cast("double") * F.col("all_s")) / ((F.col("s") + 1).cast("double") * F.col("all_t"))
    return j.join(F.broadcast(all_)).select("bucket", F.floor(F.ln(ratio) * 1000).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) of a u in (0, 1) from 32 bits of the SHA-256 of seed and id; a null id reads as ''."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.ln(-F.ln(u)) * F.lit(-1000.0))


def weights(documents: DataFrame, gain: list[int], how: Resample | None = None) -> DataFrame:
    """doc_id, n_words, n_features, total (the sum of its features' gains) of each row of documents.

    The chunks of a long text add up by doc_id and digest; rows that are alike in
    both have like chunks, which count once and come back as often as there are rows.
    """
    how = how or Resample()
    worth = np.array(gain, np.int64)  # how.buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(4).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in _text.slices(batch.column(3)):
                bucket, row, words = features(data, offsets, own[lo:hi], how)
                n = np.bincount(row, minlength=hi - lo)
                # gains are below 10**5 in size and a slice has below 10**8 features: exact in doubles
                total = np.bincount(row, worth[bucket], minlength=hi - lo).astype(np.int64)
                keys = [batch.column(k).slice(lo, hi - lo) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], names=["doc_id", "digest", "part", *sums])
        _text.release()

    sums = ["n_words", "n_features", "total"]
    schema = "doc_id long, digest string, part int, n_words long, n_features long, total long"
    cut_up = pieces(documents, how).mapInArrow(run, schema).groupBy("doc_id", "digest", "part").agg(*[F.first(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n"))
    # a long text without a word has no chunk
    blank = documents.filter((F.octet_length("text") > how.chunk) & ~F.regexp_like("text", F.lit(WORD))).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in sums])
    long = cut_up.groupBy("doc_id", "digest").agg(*[F.sum(c).alias(c) for c in sums], F.first("n").alias("n"))
    long = long.select("doc_id", *sums, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_i")).drop("_i")
    return short(documents, how).mapInArrow(run, schema).select("doc_id", *sums).unionByName(long).unionByName(blank)


def resample(documents: DataFrame, target: DataFrame, how: Resample | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of documents, drawn towards the texts of target.

    rank is 1, 2, 3 ... by falling score, ties to the smaller doc_id (null first), for the
    floor(percent N / 100) highest of the N documents with how.least words or more; null
    for the rest.  Null and empty texts have no features and weigh 0.  Rows that
    repeat a doc_id, or have a null one, are documents of their own (they share their
    noise; of equal scores that with fewer features goes first).  An empty target has T = 0;
    empty documents give no rows.  Other columns are not read.  Texts are read whole,
    however long.
    """
    how = how or Resample()
    found = gains(documents, target, how).orderBy("bucket").collect()  # how.buckets rows
    per_row = weights(documents.select("doc_id", "text"), [r["gain"] for r in found], how)
    mean = F.when(F.col("n_features") > 0, F.expr("total div n_features - if(total % n_features < 0, 1, 0)")).otherwise(F.lit(0)).cast("long")
    scored = per_row.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("doc_id"), how.seed))
    scored = written(scored.drop("total").withColumn("row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= how.least)
    n = able.count() * how.percent // 100
    order = ["least", "doc_id", "n_features", "weight", "row"]
    ranked = dense_ids(able.withColumn("least", -F.col("score")).select(*order), *order, name="place")
    drawn = ranked.filter(F.col("place") < n).select("row", (F.col("place") + 1).alias("rank"))
    return scored.join(drawn, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
