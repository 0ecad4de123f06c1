"""Quality rules by tokeniser fertility, beside plain counts of words, symbols and repeats.

Public vocabularies measure how well a text fits them: characters per token, the
share of byte-fallback tokens, and the entropy of the text's tokens.  What is usual
is learned from the documents themselves: for each language (where the table names
it) or script, and each class of length, every measure has a band around its median,
as wide as a number of median deviations.  A text outside a band of its group is
rejected, with the measure's name as the reason.

The measures are written once beside the documents; bands come from exact counts of
all documents by group and small steps of each measure, which are aggregated where
they lie.  Only the bands, a few rows a group, are broadcast, below Spark's threshold.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import _text
from gridloom.llm._store import written
from gridloom.llm.pieces import _put

#: Byte-level pieces for many languages, and pieces with byte fallback.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model")
#: Pieces that a word is first cut into: letters, digits, other signs.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Measures of a vocabulary, and the steps in which they are counted.
MEASURES = {"chars_per_token": 0.002, "byte_share": 0.001, "entropy": 0.005}
#: Bytes of remembered words beyond which all are forgotten.
REMEMBERED = 20 << 20


@dataclass(frozen=True)
class Rules:
    """Base rules: least_words, repeat_percent, window.  Fertility: a measure may lie `low` median deviations below its group's
    median or `high` above (a deviation counts as `least` of its step at least); texts of fewer than least_tokens tokens are
    too short for it, and groups of fewer than least_group texts take the band of their script, `wider` times as far, as it
    mixes languages, or none."""

    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    symbols: str = "#*$%&|<>"
    vocabularies: tuple[str, ...] = VOCABULARIES
    low: float = 4.0
    high: float = 8.0
    wider: float = 2.0
    least: float = 8.0
    least_tokens: int = 40
    least_group: int = 50


class _Vocabularies:
    """Encoders of single words by each vocabulary, with the words seen; kept for a task."""

    def __init__(self, paths: tuple[str, ...]):
        self.encode, self.single, self.sizes = [], [], []
        for path in paths:
            if path.endswith(".model"):
                import sentencepiece

                sp = sentencepiece.SentencePieceProcessor(model_file=path)
                self.single.append(np.array([sp.is_byte(i) for i in range(sp.get_piece_size())]))
                self.encode.append(lambda words, sp=sp: sp.encode(words, num_threads=1))
            else:
                import tiktoken

                with open(path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
                single = np.zeros(max(ranks.values()) + 1, bool)
                for piece, i in ranks.items():
                    single[i] = len(piece) == 1 and piece[0] >= 0x80
                self.single.append(single)
                own = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
                self.encode.append(lambda words, own=own: [own.encode_ordinary(" " + w) for w in words])
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.held = 0
        self.flat = [np.zeros(1 << 10, np.int32) for _ in self.encode]
        self.first = [np.zeros(1 << 10, np.int64) for _ in self.encode]
        self.size = [np.zeros(1 << 10, np.int64) for _ in self.encode]
        self.used = [0] * len(self.encode)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, by which first, size and flat give their tokens."""
        if self.held > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.slots]
        if new:
            slot = len(self.slots)
            texts = [w.decode("utf-8", "replace") for w in new]
            for v, encode in enumerate(self.encode):
                ids = encode(texts)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                self.flat[v] = _put(self.flat[v], self.used[v], flat)
                self.first[v] = _put(self.first[v], slot, self.used[v] + np.cumsum(sizes) - sizes)
                self.size[v] = _put(self.size[v], slot, sizes)
                self.used[v] += len(flat)
                self.held += 4 * len(flat)
            self.slots.update((w, slot + k) for k, w in enumerate(new))
            self.held += sum(map(len, new)) + 160 * len(new)
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))


_loaded: dict[tuple[str, ...], _Vocabularies] = {}


def _entropy_parts(keys: np.ndarray, n_docs: int, vocab: int) -> np.ndarray:
    """Sum of c*log2(c) over the counts c of each document's distinct tokens; keys = doc * vocab + token."""
    if not len(keys):
        return np.zeros(n_docs)
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    c = np.diff(np.append(edge, len(keys))).astype(float)
    return np.bincount(keys[edge] // vocab, c * np.log2(c), n_docs)


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """The rules' counts, each text's script and, for each vocabulary v, tokens_v and its measures, of a slice's texts."""
    n = len(offsets) - 1
    starts, ends, rows = _text.words(data, offsets)
    hashes = _text.spans_hash(data, starts, ends)
    n_words = _text.counts(rows, n)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    table = np.zeros(256, bool)
    table[list(rules.symbols.encode())] = True
    out = {"n_words": n_words, "word_chars": per_row((~_text.SPACES[data]) & ((data & 0xC0) != 0x80)), "n_symbols": per_row(table[data])}

    # lines with a word that equal an earlier line of their text
    l_starts, l_ends, l_rows = _text.runs(data != 10, offsets)
    before = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    some = before[1] > before[0]
    l_starts, l_ends, l_rows = l_starts[some], l_ends[some], l_rows[some]
    key = _text.mix(_text.spans_hash(data, l_starts, l_ends) + l_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = _text.counts(l_rows, n) - _text.counts(l_rows[first], n)

    # words in windows that occur twice or more in their text
    w_hash, at = _text.shingles(hashes, rows, rules.window)
    w_hash = _text.mix(w_hash + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(w_hash)
    same = w_hash[order][1:] == w_hash[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + rules.window] -= 1
    out["n_repeat_words"] = _text.counts(rows[np.cumsum(cover[:-1]) > 0], n)

    # tokens of each vocabulary, each distinct word encoded with the space before it
    if rules.vocabularies not in _loaded:
        _loaded[rules.vocabularies] = _Vocabularies(rules.vocabularies)
    vocabularies = _loaded[rules.vocabularies]
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    slot = vocabularies.look_up([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    for v, single in enumerate(vocabularies.single):
        size = vocabularies.size[v][slot][which]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        tokens = vocabularies.flat[v][np.repeat(vocabularies.first[v][slot][which] - (upto - size), size) + np.arange(total)].astype(np.int64)
        token_rows = np.repeat(rows, size)
        n_tokens = _text.counts(token_rows, n)
        many = np.maximum(n_tokens, 1)
        out[f"tokens_{v}"] = n_tokens
        out[f"chars_per_token_{v}"] = out["word_chars"] / many
        out[f"byte_share_{v}"] = np.bincount(token_rows, single[tokens], n) / many
        out[f"entropy_{v}"] = np.where(n_tokens > 0, np.log2(many) - _entropy_parts(token_rows * len(single) + tokens, n, len(single)) / many, 0.0)

    # scripts by the lead bytes of their letters
    lead = {"latin": ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC3) & (data <= 0xCA), "greek-cyrillic": (data >= 0xCD) & (data <= 0xD4), "hebrew-arabic": (data >= 0xD6) & (data <= 0xDB), "indic": data == 0xE0, "cjk": (data >= 0xE3) & (data <= 0xED), "other": (data == 0xE1) | (data == 0xE2) | (data >= 0xEE)}
    out["script"] = np.array(list(lead))[np.argmax(np.stack([per_row(x) for x in lead.values()]), axis=0)]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _columns(rules: Rules) -> list[T.StructField]:
    """The columns that measured() adds, without their prefix."""
    kinds = [(c, T.LongType()) for c in COUNTS] + [("script", T.StringType())]
    for v in range(len(rules.vocabularies)):
        kinds += [(f"tokens_{v}", T.LongType()), *((f"{m}_{v}", T.DoubleType()) for m in MEASURES)]
    return [T.StructField(n, t) for n, t in kinds]


def measured(documents: DataFrame, rules: Rules, prefix: str) -> DataFrame:
    """documents with the measures of each whole text in columns whose names begin with prefix; written once."""
    added = _columns(rules)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _text.slices(batch.column(at)):
                m = measure(data, offsets, rules)
                columns = [c.slice(lo, hi - lo) for c in batch.columns] + [pa.array(m[f.name].tolist() if f.name == "script" else m[f.name]) for f in added]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(prefix + f.name for f in added)])
        _loaded.clear()  # the worker goes on to other tasks, of other stages too
        _text.release()

    schema = T.StructType([*documents.schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in added)])
    return written(documents.mapInArrow(run, schema))


def bands(texts: DataFrame, rules: Rules, prefix: str, group: Column, wider: float | Column = 1.0) -> DataFrame:
    """grp, size (class of length), and for each measure its lowest and highest usual value, of the texts that the base rules leave.

    Medians are those of exact counts by small steps of the measure, so reruns agree.
    wider: a factor of the band's reach.
    """
    names = [f"{m}_{v}" for v in range(len(rules.vocabularies)) for m in MEASURES]
    step = F.create_map(*[F.lit(x) for n in names for x in (n, MEASURES[n.rsplit("_", 1)[0]])])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(prefix + n) / MEASURES[n.rsplit("_", 1)[0]]).cast("long").alias("at")) for n in names]))
    long = texts.filter(~_base(rules, prefix) & (F.col(f"{prefix}tokens_0") >= rules.least_tokens))
    cells = long.select(group.alias("grp"), _length(prefix).alias("size"), stacked.alias("s")).groupBy("grp", "size", "s.name", "s.at").agg(F.count(F.lit(1)).alias("n"))
    key = ["grp", "size", "name"]

    def median(rows: DataFrame, of: str, name: str) -> DataFrame:
        """The least value of `of` that half of the texts don't exceed; a window holds one row a step."""
        run = F.sum("n").over(Window.partitionBy(*key).orderBy(of).rowsBetween(Window.unboundedPreceding, 0))
        half = rows.withColumn("run", run).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
        return half.filter(F.col("run") * 2 >= F.col("all")).groupBy(*key).agg(F.min(of).alias(name), F.max("all").alias("texts"))

    middle = median(cells, "at", "mid")
    away = cells.join(middle.drop("texts"), key).withColumn("off", F.abs(F.col("at") - F.col("mid"))).groupBy(*key, "off").agg(F.sum("n").alias("n"))
    spread = F.greatest(F.col("dev"), F.lit(rules.least)) * 1.4826 * step[F.col("name")] * wider
    both = middle.join(median(away, "off", "dev").drop("texts"), key).filter(F.col("texts") >= rules.least_group)
    low, high = F.col("mid") * step[F.col("name")] - rules.low * spread, F.col("mid") * step[F.col("name")] + rules.high * spread
    return both.groupBy("grp", "size").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(low.alias("low"), high.alias("high"))))).alias("band"))  # one entry a measure


def _length(prefix: str) -> Column:
    """Class of length: the rounded log2 of the tokens, between 5 and 14."""
    return F.greatest(F.lit(5), F.least(F.lit(14), F.floor(F.log2(F.greatest(F.col(f"{prefix}tokens_0"), F.lit(1)))))).cast("int")


def _base(rules: Rules, prefix: str) -> Column:
    return (F.col(f"{prefix}n_words") < rules.least_words) | (100 * F.col(f"{prefix}n_repeat_words") > rules.repeat_percent * F.col(f"{prefix}n_words"))


def judged(documents: DataFrame, rules: Rules, prefix: str) -> DataFrame:
    """measured() with base_failed, kept and reason, under the same prefix."""
    texts = measured(documents, rules, prefix)
    script = F.concat(F.lit("script "), F.col(prefix + "script"))
    group = F.coalesce(F.concat(F.lit("lang "), F.col("lang").cast("string")), script) if "lang" in documents.columns else script
    own, wide = written(bands(texts, rules, prefix, group, F.when(F.startswith(F.col("grp"), F.lit("script ")), rules.wider).otherwise(1.0))), written(bands(texts, rules, prefix, script, rules.wider))
    names = {x: f"{prefix}{x}" for x in ("grp", "script_key", "size", "own", "wide", "base_failed", "reason", "kept")}
    t = texts.withColumns({names["grp"]: group, names["script_key"]: script, names["size"]: _length(prefix)})
    for side, by, name in ((own, "grp", "own"), (wide, "script_key", "wide")):
        side = side.select(F.col("grp").alias("_g"), F.col("size").alias("_s"), F.col("band").alias(names[name]))
        t = t.join(side, (t[names[by]] == side["_g"]) & (t[names["size"]] == side["_s"]), "left").drop("_g", "_s")
    band = F.coalesce(names["own"], names["wide"])
    base, reason = _base(rules, prefix), F.when(_base(rules, prefix), F.lit("base"))
    long = F.col(f"{prefix}tokens_0") >= rules.least_tokens
    for m in MEASURES:
        for v in range(len(rules.vocabularies)):
            x, b = F.col(f"{prefix}{m}_{v}"), band[f"{m}_{v}"]
            reason = reason.when(long & ((x < b["low"]) | (x > b["high"])), F.lit(m))
    reason = F.coalesce(reason, F.lit(""))
    return t.withColumns({names["base_failed"]: base, names["reason"]: reason, names["kept"]: reason == ""})


def _prefix(columns: list[str]) -> str:
    """A beginning that no column's name has."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def quality(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row of counts, verdict (base_failed, kept, reason) and measures for each document's whole text.

    Null and empty texts have no word and fail the base rule.  Repeated rows are
    judged alike and each counts for the bands, which follow most texts of a group:
    where over half of a group is junk, they follow the junk.  A null lang falls to
    the script.  Columns beside doc_id, text and lang are not read; an empty table
    gives no rows.  A very long text is measured whole, as a slice of its own.
    """
    rules = rules or Rules()
    own = [c for c in ("doc_id", "text", "lang") if c in documents.columns]
    texts = documents.select(*own)
    p = "_q_"
    names = [*COUNTS, "base_failed", "kept", "reason", "script", *(f.name for f in _columns(rules) if f.name not in COUNTS and f.name != "script")]
    return judged(texts, rules, p).select("doc_id", *[F.col(p + n).alias(n) for n in names])


def keep_good(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    prefix = _prefix(documents.columns)
    return judged(documents, rules or Rules(), prefix).filter(F.col(prefix + "kept")).select(*documents.columns)
