"""Sources and sinks: typed tables, all-text CSV with declared roles, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.morton import key_of, with_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its literal name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; tab-separated for .tsv; quotes double inside quotes and may hold line breaks; blank is null."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', sep="\t" if path.endswith(".tsv") else ",")


#: The endings of image files.
IMAGE_KINDS = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff")


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """filename, path, length of the image files directly in a folder; repeated base names are an error for the caller to see in n."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    files = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return files.filter(F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(*IMAGE_KINDS)).orderBy("filename")


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that are not lists, maps or structs."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]


def _home(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that is unset (tests, one machine), a temporary folder of this machine is
    used; on a cluster the setting is required, as executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gridloom-{spark.sparkContext.applicationId}"


#: The folders that this driver has named, by application, in order.
_named: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path in the application's folder, which the driver and all executors share."""
    path = f"{_home(spark)}/{uuid.uuid4().hex}"
    named(spark).append(path)
    return path


def named(spark: SparkSession) -> list[str]:
    """The paths that shared_dir() has given out in this application, in order."""
    return _named.setdefault(spark.sparkContext.applicationId, [])


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored folders that no DataFrame in use reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application stored; DataFrames that read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written once in the application's folder and read back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def described(df: DataFrame) -> list[tuple[str, str]]:
    """Name and type of each column, without a scan."""
    return df.dtypes


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of Arrow IPC files (stream or file form), each file read by the task that holds it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                opened = pa.ipc.open_file(raw) if raw.to_pybytes()[:6] == b"ARROW1" else pa.ipc.open_stream(raw)
                yield from opened.read_all().to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)


def read_tile(spark: SparkSession, path: str, layout_id: str, z: int, tx: int, ty: int) -> DataFrame:
    """The rows of one tile of write_tiles' table: its folder by layout and level, its row groups by the tile's key."""
    rows = spark.read.parquet(path).filter((F.col("layout_id") == layout_id) & (F.col("z") == z) & (F.col("key") == key_of(tx, ty)))
    return rows.drop("key")


def fixture(spark: SparkSession, n: int) -> DataFrame:
    """fixture_of the ids 0 … n - 1."""
    return fixture_of(spark.range(n))


def fixture_of(ids: DataFrame) -> DataFrame:
    """id, filename, taken, kind, px, py, tags of rows (id) that depend on the id alone, in whatever order and with whatever others they come."""
    i = F.col("id")
    pick = lambda salt, m: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(m))
    kinds = F.array(*[F.lit(k) for k in ("bird", "fern", "moss", "")])
    return ids.select(
        i, F.concat(F.lit("img_"), F.lpad(i.cast("string"), 7, "0"), F.lit(".jpg")).alias("filename"),
        F.when(pick(1, 20) != 0, F.timestamp_seconds(pick(2, 1_500_000_000)).cast("timestamp_ntz")).alias("taken"),
        F.get(kinds, pick(3, 4).cast("int")).alias("kind"), (pick(4, 100_000) / 1000.0).alias("px"), F.when(pick(5, 30) != 0, pick(6, 100_000) / 1000.0).alias("py"),
        F.concat_ws("|", F.concat(F.lit("t"), pick(7, 9)), F.concat(F.lit("t"), pick(8, 9))).alias("tags"),
    )


def write_tiles(cells: DataFrame, path: str, parts: int | None = None) -> None:
    """Tile rows (layout_id, z, tx, ty, id and others) by layout and level, each file sorted by the tiles' Morton keys, so that a tile's read, or a view's, touches few row groups.

    The rows are dealt out by ranges of (layout_id, z, key): a level of any size is written by many tasks, `parts` of them if given.
    """
    keyed = with_key(cells)
    ordered = keyed.repartitionByRange(*[parts] * bool(parts), "layout_id", "z", "key").sortWithinPartitions("layout_id", "z", "key", "id")
    ordered.write.partitionBy("layout_id", "z").option("parquet.block.size", 1 << 20).mode("overwrite").parquet(path)


def checked_images(files: DataFrame) -> DataFrame:
    """scan_images' rows, or an error where there is none or where names repeat, which names some of them."""
    if files.isEmpty():
        raise ValueError("the folder holds no image")
    twice = [r["filename"] for r in files.groupBy("filename").count().filter("count > 1").orderBy("filename").limit(20).collect()]
    if twice:
        raise ValueError(f"several images have these names: {', '.join(twice)}")
    return files


def write_tags(metadata: DataFrame, tags: list[str], path: str) -> None:
    """id and the tag columns; nothing where there is no tag column."""
    if not tags:
        return
    metadata.select("id", *tags).write.mode("overwrite").parquet(path)
