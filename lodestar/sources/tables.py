"""Sources, sinks and catalog helpers (survey 2A).

Everything returns a lazy DataFrame; the only actions are the writes
themselves and the empty-frame guard.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from lodestar.session import scratch_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a Parquet scan (pushdown and pruning by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_name_from_path(path: str) -> str:
    """Table name = file basename without extension (A1)."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Create-or-replace ``name`` as a table whose files live at a fresh path
    in the shared scratch folder (never a machine-local warehouse, and no
    clash with files a previous session left under the same name)."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("path", scratch_path(spark, f"table-{name}")).saveAsTable(name)
    return spark.table(name)


CORRUPT = "_rejected_line"


def csv_reader(spark: SparkSession, multi_line: bool = False):
    """CSV with a header.  ``multi_line`` is for values with line breaks: it makes
    every file one task, so it is off unless asked for."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)


def csv_to_table(spark: SparkSession, path: str, schema=None, name: str | None = None, multi_line: bool = False) -> DataFrame:
    """A1: load a CSV with a header and create-or-replace a table of the same name.

    With ``schema`` the file is read once and a line that does not fit it is an
    error (see :func:`load_csv`); inference costs an extra pass over the file.
    """
    reader = csv_reader(spark, multi_line)
    reader = reader.schema(schema).option("mode", "FAILFAST") if schema is not None else reader.option("inferSchema", True)
    return save_table(reader.csv(path), name or table_name_from_path(path))


def load_csv(spark: SparkSession, path: str, schema: str, name: str | None = None, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: typed load that loses no line: (table of the rows that fit the schema,
    table ``<name>_rejected`` of the lines that do not, as they are)."""
    name = name or table_name_from_path(path)
    rows = (csv_reader(spark, multi_line).schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    parsed = save_table(rows, f"{name}_parsed")                     # parsed once for both
    loaded = save_table(parsed.where(f"{CORRUPT} is null").drop(CORRUPT), name)
    return loaded, save_table(parsed.where(f"{CORRUPT} is not null").select(CORRUPT), f"{name}_rejected")


def frame_to_table(df: DataFrame, name: str) -> DataFrame:
    """A4: write a frame as a table (replace); an empty frame is rejected."""
    if df.isEmpty():
        raise ValueError(f"refusing to store an empty frame as {name!r}")
    return save_table(df, name)


def create_table_as(spark: SparkSession, name: str, query: str | DataFrame) -> DataFrame:
    """A2/A3: CREATE OR REPLACE TABLE name AS <query>; returns the stored table."""
    df = spark.sql(query) if isinstance(query, str) else query
    return save_table(df, name)


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """A3: run SQL and return its frame (no text splitting needed in Spark)."""
    return spark.sql(query)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV sink with a header row, one file per partition (no coalesce(1))."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_csv_optional(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame | None:
    """An optional source; a missing path gives ``None`` instead of failing,
    any other fault is raised."""
    reader = csv_reader(spark, multi_line)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    try:
        return reader.csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def csv_roundtrip(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as CSV to the shared scratch folder and read it back typed."""
    spark = df.sparkSession
    path = write_csv(df, scratch_path(spark, name))
    return csv_reader(spark, multi_line=True).schema(df.schema).csv(path)
