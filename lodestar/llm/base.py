"""Helpers shared by the training-data operators: registry, shared scratch
tables, let-binding for nested array expressions and skew-safe lookups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"        # what separates words, everywhere in this package
HEAVY_SHARE = 1000                 # a key is heavy when it holds over 1/1000 of all rows


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back:
    cuts the lineage with files every executor sees, so a lost executor costs
    no recomputation of what stands below."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000         # narrow rows (ids, digests) up to which a lookup side is broadcast


def near(small: DataFrame) -> DataFrame:
    """``small`` (a stored, narrow table), marked for broadcast when its counted
    rows allow it; beyond that the join shuffles both sides as usual."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches small enough for whole texts in a small worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def trimmed(run):
    """``run`` over Arrow batches; at a task's end the worker, which lives on for
    other tasks, gives the memory it no longer uses back to the system."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc only
            if trim is not None:
                trim(0)
    return wrapped


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (also
    inside lambdas, where an inlined expression would run per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of words; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lookup(facts: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``facts`` to ``groups`` (one row per ``key``, ``size`` =
    rows of ``facts`` with that key), safe when one key holds most rows.

    Keys with over 1/HEAVY_SHARE of ``total`` are at most HEAVY_SHARE (their
    sizes add up to no more than ``total``), so they are broadcast.  The other
    keys meet in a shuffle; rows already served go to it under a key of their
    own (a hash of ``spread``) and so land evenly.
    """
    cols = [c for c in groups.columns if c != key]
    is_heavy = F.col(size) * HEAVY_SHARE > F.lit(total)
    heavy = groups.where(is_heavy).select(F.col(key), F.struct(*cols).alias("__heavy"))
    light = groups.where(~is_heavy).select(F.col(key).alias("__key"), F.struct(*cols).alias("__light"))
    out = facts.join(F.broadcast(heavy), key, "left")
    own = F.xxhash64(spread)                       # one that equals a real key does no harm: the heavy match counts
    if groups.schema[key].dataType.typeName() != "long":
        own = F.concat(F.lit("#"), own.cast("string")).cast(groups.schema[key].dataType)
    out = out.withColumn("__key", F.when(F.col("__heavy").isNotNull(), own).otherwise(F.col(key)))
    out = out.join(light, "__key", "left").withColumn("__got", F.coalesce("__heavy", "__light"))
    return out.select(*facts.columns, *[F.col("__got")[c].alias(c) for c in cols])
