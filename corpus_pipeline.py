"""A training-corpus pipeline: five stages over documents, each over all that the one before kept.

Rejects by quality rules, keeps one document of each near-duplicate class, cuts
strings that repeat across documents, mixes sources to target weights, encodes.

A stage's rows are written and read again before the next stage begins.  So what
earlier stages stored for themselves is deleted then: a pipeline never holds more
than one stage's tables beside its documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import _store, mixing, neardup, pieces, quality, repeats
from gridloom.session import ship
from gridloom.sources.tables import dropped, named

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What stages have stored for themselves, by application.
_own: dict[str, list[str]] = {}


def _is_table(docs: DataFrame) -> bool:
    """Whether docs is a table read from files and nothing else, so that no earlier stage's tables are behind it."""
    return docs._jdf.queryExecution().analyzed().children().isEmpty() and bool(docs.inputFiles())


def stage(f: Stage) -> Stage:
    """A stage, before which the tables that earlier ones stored are deleted if docs is a written table."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        held = _own.setdefault(spark.sparkContext.applicationId, [])
        if held and _is_table(docs):
            read = docs.inputFiles()
            dropped(spark, [p for p in held if not any(p.rpartition("/")[2] in x for x in read)])
            held.clear()
        before = len(named(spark))
        out = f(spark, docs, sf_dir)
        held += named(spark)[before:]
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with all their columns as they were, whatever their names.

    Null and empty texts have too few words and go; very long texts are judged whole;
    rows that repeat are judged alike; an empty table gives no rows.
    """
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each near-duplicate class, with all its columns.

    Null and empty texts are classes of their own; rows that repeat a doc_id, or have a
    null one, are documents of their own, and exact copies are one class; ties go to the
    earlier row; an empty table gives no rows.
    """
    return neardup.keep_firsts(docs)


@stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that repeat across documents; those of which nothing is left go.

    Null texts stay null; rows of one doc_id don't cut each other; very long texts are
    cut whole; an empty table gives no rows; the other columns stay but for n_chars,
    which follows the text.
    """
    return repeats.remove(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, one row for each time, with the columns of documents.

    Null texts have size 0; null sources are a source of their own; rows that repeat a
    doc_id, or have a null one, are taken each alone; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs, ordered=False)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, n_bytes, ids, round_trip, position of each document of the mix; position is its place in the mix's order.

    Null texts have null ids; repeated rows have places of their own; an empty table
    gives no rows; other columns are not read.
    """
    return pieces.encode(mixing.placed(docs), keep=("position",))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("encoded", encoded),
]
#: Signatures, suffix sorting and encoding are beyond SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each stage's rows are written to the shared folder and read again.

    Nulls, repeats, ties, very long texts, empty tables and clashing columns: as each stage says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _store.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
