"""Relational building blocks: set operations, record unions, keyed patches,
lookups with defaults (survey 2B, 2C, 2G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_common_keys(frames: list[DataFrame], out: str = "n_common") -> DataFrame:
    """COUNT(*) over a distinct INTERSECT of single-column frames.

    Catalyst rewrites INTERSECT into left-semi joins over distinct keys, so each
    input is deduplicated map-side before it is shuffled on the key.
    """
    first = frames[0]
    name = first.columns[0]
    common = reduce(lambda a, b: a.intersect(b.toDF(name)), frames[1:], first)
    return common.agg(F.count(F.lit(1)).alias(out))


def union_records(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; a column missing from one side is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_non_null(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.select(col).na.drop().distinct()


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, computed once and marked for broadcast if its counted rows allow it;
    beyond that the join shuffles both sides and AQE splits what is skewed."""
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= rows else kept


def any_null(cols: list[str]) -> Column:
    """B2: OR-fold of isNull over columns."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def apply_patches(df: DataFrame, patches: DataFrame, key: str, override: bool = False) -> DataFrame:
    """Keyed point updates from a long patch table (key, column, value).

    The patch table is pivoted to one row per key (its size is the number of
    patched cells); AQE broadcasts it when its runtime size is under the
    threshold and shuffles otherwise.  Without ``override`` a patch only fills
    nulls (imputation); with it the patch wins (correction of a wrong value).
    """
    named = patches.where(F.col("column").isin(df.columns)).select("column").distinct()
    cols = [r[0] for r in named.collect()]        # at most the columns of df
    wide = patches.groupBy(key).pivot("column", cols).agg(F.first("value"))
    wide = wide.select(key, *[F.col(c).alias(f"__patch_{c}") for c in cols])
    joined = df.join(wide, key, "left")
    out = []
    for c in df.columns:
        if c in cols:
            p = F.col(f"__patch_{c}").cast(df.schema[c].dataType)
            out.append((F.coalesce(p, F.col(c)) if override else F.coalesce(F.col(c), p)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def lookup_with_defaults(df: DataFrame, lookup: DataFrame, key: str,
                         defaults: dict[str, object]) -> DataFrame:
    """Left join a distinct-key result and fill misses with defaults.

    The lookup side is one row per distinct key; AQE broadcasts it when its
    runtime size is under the threshold and falls back to a shuffle join
    otherwise, so no size assumption is hard-coded.
    """
    joined = df.join(lookup, key, "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                           for c in joined.columns])


def impute_from_text(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Fill the nulls of a column with what a pattern's first group finds in a
    text, cast to the column's type; a value that is there is kept.  ``<column>_imputed``
    says where."""
    types = dict(df.dtypes)
    found = {c: F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit("")).try_cast(types[c]) for c, p in patterns.items()}
    out = [F.coalesce(F.col(c), found[c]).alias(c) if c in found else F.col(c) for c in df.columns]
    return df.select(*out, *[(F.col(c).isNull() & e.isNotNull()).alias(f"{c}_imputed") for c, e in found.items()])
