"""Catalogue states, staleness, merges and uploads: set logic over small tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.tables import IMAGE_KINDS


def readable(datasets: DataFrame, user: str | None) -> DataFrame:
    """Public ones and the user's own; the owner shows only to the owner."""
    own = F.coalesce(F.col("owner") == F.lit(user), F.lit(False))
    return datasets.filter(F.coalesce(F.col("visibility") == "public", F.lit(False)) | own).withColumn("owner", F.when(own, F.col("owner")).otherwise(F.lit("")))


def listing(on_disk: DataFrame, records: DataFrame, jobs: DataFrame) -> DataFrame:
    """dataset_id, status (ready, processing, error, unassigned), active_job: what is on disk against what is recorded."""
    j = on_disk.withColumn("disk", F.lit(True)).join(records.withColumn("known", F.lit(True)), "dataset_id", "full_outer").join(jobs, F.col("last_job_id") == F.col("job_id"), "left")
    status = F.when(F.col("disk") & F.col("known").isNull(), "unassigned").when(F.col("disk"), "ready").when(F.col("state").isin("queued", "started"), "processing").otherwise("error")
    return j.select("dataset_id", status.alias("status"), F.when(F.col("state").isin("queued", "started"), F.col("last_job_id")).alias("active_job"))


def stale_layouts(declared: DataFrame, baked: DataFrame) -> DataFrame:
    """layout_id, state of baked (layout_id, key, fingerprint) against declared (key, fingerprint), as bags.

    stale: a baked fingerprint needs more copies than are declared; never: no
    fingerprint rows with a key; unknown: the layout has only null fingerprints.
    """
    supply = declared.groupBy("key", "fingerprint").agg(F.count(F.lit(1)).alias("supply"))
    need = baked.groupBy("layout_id", "key", "fingerprint").agg(F.count(F.lit(1)).alias("need"))
    j = need.join(supply, (need["key"] == supply["key"]) & need["fingerprint"].eqNullSafe(supply["fingerprint"]), "left").select("layout_id", need["key"], need["fingerprint"], "need", F.coalesce("supply", F.lit(0)).alias("supply"))
    bad = F.max(F.when(F.col("fingerprint").isNotNull() & (F.col("supply") < F.col("need")), 1).otherwise(0))
    known = F.max(F.when(F.col("fingerprint").isNotNull(), 1).otherwise(0))
    keyed = F.max(F.when(F.col("key").isNotNull(), 1).otherwise(0))
    return j.groupBy("layout_id").agg(bad.alias("bad"), known.alias("known"), keyed.alias("keyed")).select("layout_id", F.when(F.col("keyed") == 0, "never").when(F.col("known") == 0, "unknown").when(F.col("bad") == 1, "stale").otherwise("fresh").alias("state"))


def role_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, change of (column, fingerprint) sets: added, removed or changed."""
    a = before.groupBy("column").agg(F.array_sort(F.collect_set("fingerprint")).alias("a"))
    b = after.groupBy("column").agg(F.array_sort(F.collect_set("fingerprint")).alias("b"))
    j = a.join(b, "column", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("column", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def renamed(committed: DataFrame, producible: DataFrame) -> DataFrame:
    """layout_id, new_id, state: committed layouts whose (type, columns) another id now produces, or none."""
    p = producible.groupBy("type", "columns").agg(F.min("layout_id").alias("new_id"))
    j = committed.join(p, ["type", "columns"], "left")
    return j.select("layout_id", "new_id", F.when(F.col("new_id").isNull(), "orphaned").when(F.col("new_id") == F.col("layout_id"), "same").otherwise("renamed").alias("state"))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """layout_id, body, at: old entries keep their places, new ones with the same id replace in place, others follow."""
    j = old.withColumnsRenamed({"body": "b0", "at": "a0"}).join(new.withColumnsRenamed({"body": "b1", "at": "a1"}), "layout_id", "full_outer")
    last = old.agg(F.coalesce(F.max("at"), F.lit(-1))).first()[0]
    return j.select("layout_id", F.coalesce("b1", "b0").alias("body"), F.coalesce("a0", F.col("a1") + F.lit(last + 1)).alias("at"))


def unreferenced(files: DataFrame, live: DataFrame) -> DataFrame:
    """Versioned files (dir, name like base.v12.ext) that the live manifest does not name."""
    versioned = files.withColumn("version", F.regexp_extract("name", r"\.v(\d+)\.", 1)).filter("version != ''")
    return versioned.join(live, ["dir", "name"], "left_anti").withColumn("version", F.col("version").try_cast("long"))


def upload_check(asked: DataFrame, held: DataFrame) -> DataFrame:
    """name, state of asked (name, size, sha) against stored ones: present, mismatched or needed; hashes count if both have one."""
    h = held.select("name", F.col("size").alias("hs"), F.col("sha").alias("hh"))
    j = asked.join(h, "name", "left")
    differ = (F.col("size") != F.col("hs")) | F.coalesce(F.col("sha") != F.col("hh"), F.lit(False))
    return j.select("name", F.when(F.col("hs").isNull(), "needed").when(differ, "mismatched").otherwise("present").alias("state"))


def tally(committed: DataFrame, staged: DataFrame) -> DataFrame:
    return committed.select("size").union(staged.select("size")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def unique_selection(files: DataFrame) -> DataFrame:
    """The first file (by at) of each name, case aside, with the number of its duplicates."""
    return files.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def newly_stale(before: DataFrame, after: DataFrame, baked: DataFrame) -> DataFrame:
    """layout_id, state of baked layouts under a change of the declared prints: newly (stale by this change), still, fresh, unknown or never."""
    was, now = stale_layouts(before, baked).withColumnRenamed("state", "was"), stale_layouts(after, baked)
    return now.join(was, "layout_id").select("layout_id", F.when((F.col("state") == "stale") & (F.col("was") != "stale"), "newly").when(F.col("state") == "stale", "still").otherwise(F.col("state")).alias("state"))


def changed_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """n: how many columns a change of roles reads in another way; roles.role_changes counts the edits."""
    return role_diff(before, after).agg(F.count(F.lit(1)).alias("n"))


def presentation(records: DataFrame, fallback: DataFrame) -> DataFrame:
    """dataset, columns (render by column), links of (dataset, columns) maps: a dataset's own record wins as a block, the fallback counts only where there is none."""
    j = records.withColumnRenamed("columns", "own").join(fallback.withColumnRenamed("columns", "old"), "dataset", "full_outer").select("dataset", F.coalesce("own", "old").alias("columns"))
    links = F.array_sort(F.map_keys(F.map_filter("columns", lambda k, v: F.coalesce(v == "url", F.lit(False)))))
    return j.select("dataset", "columns", F.coalesce(links, F.array().cast("array<string>")).alias("links"))


def updated(records: DataFrame, updates: DataFrame) -> DataFrame:
    """dataset, columns after (dataset, columns) updates: a key with a value is written, with null or blank text cleared, without one kept."""
    j = records.withColumnRenamed("columns", "own").join(updates.withColumnRenamed("columns", "new"), "dataset", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    own, new = F.coalesce("own", empty), F.coalesce("new", empty)
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(new, k))
    return j.select("dataset", F.map_concat(kept, F.map_filter(new, lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))).alias("columns"))


def unresolved(keys: DataFrame, known: DataFrame) -> DataFrame:
    """dataset, key of presented keys that name nothing known."""
    return keys.join(known, ["dataset", "key"], "left_anti").select("dataset", "key").distinct()


def layout_states(committed: DataFrame, planned: DataFrame, stages: DataFrame) -> DataFrame:
    """layout_id, committed, state of (layout_id) committed and planned layouts and (layout_id, stage) of a running job.

    A committed layout has the state of its new bake, or none; another one shows only
    while it waits or runs: what is done is committed, what failed does not exist.
    """
    every = committed.select("layout_id", F.lit(True).alias("c")).union(planned.select("layout_id", F.lit(False))).union(stages.select("layout_id", F.lit(False)))
    every = every.groupBy("layout_id").agg(F.bool_or("c").alias("committed"))
    j = every.join(planned.select("layout_id", F.lit(True).alias("plan")).distinct(), "layout_id", "left").join(stages, "layout_id", "left")
    state = F.when(F.col("stage") == "running", "baking").when((F.col("stage") == "queued") | (F.col("stage").isNull() & F.col("plan")), "queued")
    return j.select("layout_id", "committed", state.alias("state")).filter("committed or state is not null")


def band_of(hits: DataFrame, bands: DataFrame) -> DataFrame:
    """hits (label, value) with the band's (label, type, text, missing, x0 … y1) box: same label and exact text, of a category that is not the missing one."""
    b = bands.filter("type = 'categorical' and not missing").select("label", F.col("text").alias("value"), "x0", "y0", "x1", "y1")
    return hits.join(b, ["label", "value"], "left")


#: FNV-1a of 32 bits: where a hash begins, and its factor.
FNV_BEGIN, FNV_FACTOR = 0x811C9DC5, 0x01000193


def _fnv(h: int, units: np.ndarray) -> int:
    """The hash h carried on over 16-bit units, in time that follows their number.

    A unit meets only the low 16 bits, and a product's bit k is the factor's bit k
    changed by lower ones: so all states' low bits come bit by bit, each a running
    xor.  What the units added to each state is then a sum with the factor's powers.
    """
    factor = np.uint32(FNV_FACTOR)
    for i in range(0, len(units), 1 << 16):
        u = units[i : i + (1 << 16)].astype(np.uint32)
        met = np.zeros(len(u), np.uint32)  # low bits of each state after its unit
        for k in range(16):
            bit = u >> k & 1
            bit[1:] ^= (met[:-1] * factor) >> k & 1
            bit[0] ^= h >> k & 1
            met |= np.bitwise_xor.accumulate(bit) << k
        power = np.multiply.accumulate(np.full(len(u), factor))
        added = np.sum((met - (met ^ u)) * power[::-1], dtype=np.uint32)
        h = (h * int(power[-1]) + int(added)) & 0xFFFFFFFF
    return h


def selection_print(files: DataFrame) -> DataFrame:
    """selection, print of (selection, name, size) files, whatever their order: FNV-1a of 32 bits over the sorted lines of base name and size, as hex.

    Lines sort and count by UTF-16 units.  A hash is a chain, so one task follows a
    selection's lines, but it reads them in sorted batches and holds none.
    """
    line = F.concat_ws(" ", F.element_at(F.split(F.translate("name", "\\", "/"), "/"), -1), F.col("size").cast("string"))
    units = F.encode(F.concat(F.lit("\n"), line), "UTF-16BE")  # the first line's break is skipped
    lines = files.select("selection", units.alias("units")).repartition("selection").sortWithinPartitions("selection", "units")
    shape = T.StructType([lines.schema["selection"], T.StructField("print", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([last, pa.array([f"{h:08x}"])], names=["selection", "print"])

        for batch in batches:
            column, text = batch.column(0), batch.column(1).cast(pa.large_binary())
            _, places, data = text.buffers()
            at = np.frombuffer(places, np.int64, count=len(text) + 1, offset=8 * text.offset)
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else []
            for i, j in zip(edges, edges[1:], strict=False):
                begins = h is None or not column.slice(i, 1).equals(last)
                if begins and h is not None:
                    yield row()
                if begins:
                    last, h = column.slice(i, 1), FNV_BEGIN
                start = int(at[i]) + 2 * begins
                h = _fnv(h, np.frombuffer(data, ">u2", count=(int(at[j]) - start) // 2, offset=start))
        if h is not None:
            yield row()

    return lines.mapInArrow(run, shape)


def selection_counts(files: DataFrame) -> DataFrame:
    """images, archives, duplicates, ignored of a selection of (name, at) files: an image whose name came before, case aside, is a duplicate."""
    end = F.lower(F.element_at(F.split("name", r"\."), -1))
    kind = F.when(end.isin(*IMAGE_KINDS), "image").when(end == "zip", "archive").otherwise("other")
    first = files.groupBy(F.lower("name").alias("key"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    image = F.col("kind") == "image"
    sums = {"images": F.when(image, 1), "archives": F.when(F.col("kind") == "archive", F.col("n")), "duplicates": F.when(image, F.col("n") - 1), "ignored": F.when(F.col("kind") == "other", F.col("n"))}
    return first.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])


def baked_staleness(baked: DataFrame, declared: DataFrame) -> DataFrame:
    """layout_id, checkable, stale_columns of layouts' (layout_id, column, print) records against the declared (column, print).

    A record without prints can't be checked and is never called fresh; a layout
    that reads no column has a record with a null column and is fresh.
    """
    known = declared.select("column", "print").distinct().withColumn("still", F.lit(True))
    j = baked.join(known, ["column", "print"], "left")
    lost = F.when(F.col("column").isNotNull() & F.col("print").isNotNull() & F.col("still").isNull(), F.col("column"))
    sure = F.bool_and(F.col("column").isNull() | F.col("print").isNotNull())
    return j.groupBy("layout_id").agg(sure.alias("checkable"), F.array_sort(F.collect_set(lost)).alias("stale_columns"))


def restamped(entries: DataFrame, version: str) -> DataFrame:
    """entries (with print, version) under a new version, if every one of them has a print; else as they are."""
    whole = entries.agg(F.bool_and(F.col("print").isNotNull()).alias("_whole"))
    return entries.join(F.broadcast(whole), F.lit(True)).withColumn("version", F.when(F.col("_whole"), F.lit(version)).otherwise(F.col("version"))).drop("_whole")  # one row


def tag_sidecars(datasets: DataFrame) -> DataFrame:
    """dataset, missing, orphan of (dataset, declared, served, sidecar): declared tag columns that its tag file does not serve, and whether a file stands there that no role asks for."""
    d = datasets.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("declared", "served")})
    return d.select("dataset", F.array_sort(F.array_except("declared", "served")).alias("missing"), (F.coalesce("sidecar", F.lit(False)) & (F.size("declared") == 0)).alias("orphan"))


def minted(records: DataFrame, owner: str, upload: str) -> DataFrame:
    """The first record by (created, id) that an owner's upload made; no row where there is none."""
    return records.filter((F.col("owner") == owner) & (F.col("upload") == upload)).orderBy("created", "id").limit(1)


#: What a dataset's block may say, and which of it an older record may hold.
BLOCK_FIELDS = ("display_name", "attribution", "attribution_url", "default_layout", "title_column")
OLD_FIELDS = BLOCK_FIELDS[:3]
#: Signs of a value at most.
LONGEST = 200


def _block(own: Column, old: Column) -> Column:
    """A dataset's own block or, where there is none, what an older record holds of it."""
    held = F.map_filter(old, lambda k, v: k.isin(*OLD_FIELDS) & v.isNotNull())
    return F.coalesce(own, held, F.create_map().cast("map<string,string>"))


def _joined(records: DataFrame, other: DataFrame, **names: str) -> DataFrame:
    return records.join(other.select("dataset", *[F.col(c).alias(n) for n, c in names.items()]), "dataset", "full_outer")


def effective(records: DataFrame, older: DataFrame, legacy: DataFrame) -> DataFrame:
    """dataset, block, columns, links of records (dataset, block, columns), with what stands in where they are silent.

    older: dataset, block of former records, which count where a dataset has no block
    at all.  legacy: dataset, url: columns that were links by an older rule; they are, but
    for those that the record describes, were it by an empty entry.  links: the
    columns that render as url, sorted.
    """
    j = _joined(_joined(records, older, old="block"), legacy, url="url")
    kind = "map<string,map<string,string>>"
    described = F.coalesce("columns", F.create_map().cast(kind))
    silent = F.filter(F.array_distinct(F.coalesce("url", F.array().cast("array<string>"))), lambda c: (c != "") & ~F.map_contains_key(described, c))
    columns = F.map_concat(described, F.map_from_entries(F.transform(silent, lambda c: F.struct(c.alias("key"), F.create_map(F.lit("render"), F.lit("url")).alias("value")))))
    out = j.select("dataset", _block(F.col("block"), F.col("old")).alias("block"), columns.alias("columns"))
    return out.withColumn("links", F.array_sort(F.map_keys(F.map_filter("columns", lambda k, v: F.coalesce(v["render"] == "url", F.lit(False))))))


def applied(records: DataFrame, updates: DataFrame, older: DataFrame, longest: int = LONGEST) -> DataFrame:
    """dataset, block, columns, refused: records after updates (dataset, block, columns), each of which counts whole or not at all.

    A key with a value is written, with null or blank text cleared, without one kept; in
    columns also by entry, where a null entry removes it and one that is cleared empty
    stays as such.  The first write of a block begins with what older records hold, as
    those stop counting then.  An update with an unknown field, a blank column or a value
    over `longest` signs is refused.
    """
    kind = "map<string,map<string,string>>"
    j = _joined(_joined(records, updates, new="block", entries="columns"), older, old="block")
    none, empty = F.create_map().cast("map<string,string>"), F.create_map().cast(kind)
    new, entries, own = F.coalesce("new", none), F.coalesce("entries", empty), F.coalesce("columns", empty)
    long = lambda v: F.coalesce(F.length(F.trim(v)) > longest, F.lit(False))
    bad = F.exists(F.map_keys(new), lambda k: ~k.isin(*BLOCK_FIELDS)) | F.exists(F.map_values(new), long)
    bad = bad | F.exists(F.map_keys(entries), lambda k: F.trim(k) == "") | F.exists(F.map_values(entries), lambda e: F.exists(F.map_values(F.coalesce(e, none)), long))
    written = lambda m: F.map_filter(m, lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))
    merged = lambda was, now: F.map_concat(F.map_filter(was, lambda k, v: ~F.map_contains_key(now, k)), written(now))
    block = F.when(F.size(new) > 0, merged(_block(F.col("block"), F.col("old")), new)).otherwise(F.col("block"))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(entries, k))
    named = F.filter(F.map_entries(entries), lambda e: e["value"].isNotNull())
    columns = F.map_concat(kept, F.map_from_entries(F.transform(named, lambda e: F.struct(e["key"].alias("key"), merged(F.coalesce(F.try_element_at(own, e["key"]), none), e["value"]).alias("value")))))
    return j.select("dataset", F.when(bad, F.col("block")).otherwise(block).alias("block"), F.when(bad, own).otherwise(columns).alias("columns"), bad.alias("refused"))
