"""Fitted category tables (2J J1, J2, J12; H17): the categories of any number of
columns, ranked in a distributed sort of the distinct values and kept as a table
(column, category, idx, n).  Nothing of it reaches the driver, so a column may
have millions of categories; rows are encoded by a join on the value.

Values are cast to text first; nulls are no category.  A value the table does
not hold (or a null) gets index -1, and no one-hot entry, like the first
category.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ordering import global_index
from lodestar.session import scratch_path

BROADCAST_ROWS = 100_000       # categories of a column up to which its table is broadcast
MAX_ONE_HOT = 100_000          # Spark ML names every entry of a one-hot vector in the plan; wider columns are label-encoded


def fit_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, category, idx, n): 0-based rank of each distinct value within
    its column, and the number of them.  Stored in the shared scratch folder."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category"))
                                          for c in cols])).alias("p")).select("p.*").where("category is not null").distinct()
    ranked = global_index(pairs, ["column", "category"], n_col=None)
    first = ranked.groupBy("column").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))       # one row per column
    table = ranked.join(F.broadcast(first), "column").select("column", "category", (F.col("idx") - F.col("first")).alias("idx"), "n")
    path = scratch_path(df.sparkSession, "categories")
    table.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def encode(df: DataFrame, col: str, table: DataFrame, out: str) -> DataFrame:
    """``out`` = rank of the value among its column's categories (double), -1 if unseen or null."""
    own = table.where(F.col("column") == col).select(F.col("category").alias("__category"), F.col("idx").alias("__idx"))
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    found = df.join(own, F.col(col).cast("string") == F.col("__category"), "left")
    return found.withColumn(out, F.coalesce(F.col("__idx"), F.lit(-1)).cast("double")).drop("__category", "__idx")


def one_hot_stage(col: str, table: DataFrame, inp: str, out: str):
    """Fitted encoder of ``inp`` (see :func:`rotated`) into a sparse vector
    without the first category; None for a column of fewer than two."""
    own = table.where(F.col("column") == col).select(((F.col("idx") + F.col("n") - 1) % F.col("n")).cast("double").alias(inp), "n")
    n = own.agg(F.max("n")).first()[0] or 0
    if n > MAX_ONE_HOT:
        raise ValueError(f"{col} has {n} categories, more than {MAX_ONE_HOT}: label-encode it")
    if n < 2:
        return None, n
    return OneHotEncoder(inputCols=[inp], outputCols=[out], dropLast=True, handleInvalid="error").fit(own.select(inp)), n


def rotated(idx, n: int):
    """The index as the encoder takes it: it drops its last category, so the
    first comes last; an unseen value goes with it."""
    return F.when(idx <= 0, F.lit(float(n - 1))).otherwise(idx - 1)
