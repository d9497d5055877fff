"""Order-dependent operators without a single-partition window (survey 2E, 2F).

A global ``row_number()``/``ntile()`` with no PARTITION BY runs in one task.
Here the exact global position is built the way a distributed sort does it:

1. range-partition and sort by the order key (sampled bounds, every task
   sorts its own range);
2. checkpoint that result to the shared checkpoint folder, which pins the
   partition contents and order across retries and cuts the lineage;
3. tag rows with ``monotonically_increasing_id`` = (partition, position);
4. count rows per partition -- one small row per partition -- and turn
   the counts into offsets with a window over that small frame;
5. broadcast the offsets (size = number of partitions) and add.

The result is the exact 0-based rank, independent of input partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POS_BITS = 33


def global_index(df: DataFrame, order_cols: list[str | Column], idx_col: str = "idx",
                 n_col: str | None = "n_total", partitions: int | None = None) -> DataFrame:
    """Append the exact 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must make the order total (add the key as a tiebreaker).
    With ``n_col`` the total row count is appended too (from the same small
    per-partition frame, no extra pass).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.checkpoint(eager=True)
    tagged = (ranged.withColumn("__gi_mid", F.monotonically_increasing_id())
              .withColumn("__gi_pid", F.shiftright("__gi_mid", _POS_BITS))
              .withColumn("__gi_pos", F.col("__gi_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    counts = tagged.groupBy("__gi_pid").agg(F.count(F.lit(1)).alias("__gi_cnt"))
    before = Window.orderBy("__gi_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__gi_pid", F.coalesce(F.sum("__gi_cnt").over(before), F.lit(0)).alias("__gi_off"),
                            F.sum("__gi_cnt").over(Window.partitionBy()).alias("__gi_n"))
    out = tagged.join(F.broadcast(offsets), "__gi_pid").withColumn(idx_col, F.col("__gi_off") + F.col("__gi_pos"))
    if n_col:
        out = out.withColumn(n_col, F.col("__gi_n"))
    return out.drop("__gi_mid", "__gi_pid", "__gi_pos", "__gi_off", "__gi_n")


def ntile_from_index(idx: Column, n: Column, k: int) -> Column:
    """0-based ``ntile(k)`` from an exact index: the first n mod k tiles get
    one extra row (same rule as SQL NTILE)."""
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(idx < big, F.floor(idx / (q + 1))).otherwise(r + F.floor((idx - big) / q)).cast("int")


def contiguous_folds(df: DataFrame, key: str, k: int, fold_col: str = "fold") -> DataFrame:
    """K consecutive blocks in key order (``ntile(k) - 1``)."""
    idx = global_index(df, [key], idx_col="__idx", n_col="__n")
    return idx.withColumn(fold_col, ntile_from_index(F.col("__idx"), F.col("__n"), k)).drop("__idx", "__n")


def batch_number(df: DataFrame, order_cols: list[str], size: int, batch_col: str = "batch_id",
                 pos_col: str = "pos") -> DataFrame:
    """Stable position over items, batch = position div size."""
    idx = global_index(df, order_cols, idx_col="__idx", n_col=None)
    return (idx.withColumn(batch_col, F.floor(F.col("__idx") / size).cast("bigint"))
            .withColumn(pos_col, (F.col("__idx") % size).cast("int")).drop("__idx"))


def smallest(df: DataFrame, col: str, n: int, tiebreak: str, largest: bool = False) -> DataFrame:
    """n smallest/largest non-null values; ties broken by key.

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    top n and only n rows per task reach the final merge.
    """
    order = F.col(col).desc() if largest else F.col(col).asc()
    return df.where(F.col(col).isNotNull()).orderBy(order, F.col(tiebreak).asc()).limit(n)


def rank_small(df: DataFrame, by: Column, rank_col: str = "rank") -> DataFrame:
    """Rank of a small result table (a handful of model records)."""
    return df.withColumn(rank_col, F.row_number().over(Window.orderBy(by)))
