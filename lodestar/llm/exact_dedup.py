"""Exact deduplication as a stateful stream.

Documents arrive as a file stream.  A keyed streaming aggregation without a
watermark (so its state never expires) keeps, per content digest, the stable
identifier of the row that stays, the locator of its content (file and row)
and the number of arrivals; the state is in RocksDB, on disk, with its
snapshots in the shared checkpoint folder.  A later run with the same
``state`` folder takes only the new files and goes on from the old state.
The state is read with the state data source and joined to the documents; each
row that hits a digest held by another row is compared with that row's full
bytes, and rows whose bytes differ (a digest collision) are regrouped by their
full text.

Results for odd input: null text counts as empty; a null id loses to any other;
of rows with the same id and text the one with the largest locator stays, the
others are dropped; an empty table gives no rows; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.base import lookup, query, store
from lodestar.session import scratch_path

STATE = "spark.sql.streaming.stateStore."
SETTINGS = {    # state on disk; changes are logged, not whole snapshots at each commit; no disk reserved ahead
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE + "rocksdb.changelogCheckpointing.enabled": "true",
    STATE + "rocksdb.allowFAllocate": "false",
}
COMPARE_BYTES = 32 << 20       # bytes of hits compared under one (digest, salt) key
TRIGGER_BYTES = 1 << 40       # input of one micro-batch


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _arrivals(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
    ).withColumn("digest", digest(F.col("text")))


def _streamable(path: str, files: list[str]) -> str:
    """A file stream takes a folder or a pattern; a path that is one file
    becomes the pattern that only this file matches."""
    folder, name = posixpath.split(path)
    if len(files) == 1 and posixpath.basename(files[0]) == name:
        return f"{folder}/[{name[0]}]{name[1:]}"
    return path


def update_state(spark: SparkSession, path: str, state: str, id_col="doc_id", text_col="text", digest=sha256,
                 trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """Take the files under ``path`` that the stream has not yet seen into the
    state kept in the folder ``state``; returns one row per digest."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        table = spark.read.parquet(path)
        stream = (spark.readStream.schema(table.schema).option("maxBytesPerTrigger", trigger_bytes)
                  .parquet(_streamable(path, table.inputFiles())))
        seen = _arrivals(stream, id_col, text_col, digest)
        keyed = (seen.withColumn("n_bytes", F.octet_length("text").cast("bigint")).groupBy("digest")
                 .agg(F.max(F.struct("doc_id", "locator", "n_bytes")).alias("top"), F.count(F.lit(1)).alias("group_size")))
        running = (keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
                   .trigger(availableNow=True).start())
        running.awaitTermination()
        held = spark.read.format("statestore").load(state)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    value = [f.name for f in held.schema["value"].dataType]       # buffers in the order of the aggregates
    return held.select(F.col("key.digest").alias("digest"), F.col("value")[value[0]].alias("top"),
                       F.col("value")[value[1]].alias("group_size"))


def scan_path(docs: DataFrame) -> str | None:
    """Folder (or file) that ``docs`` is a plain Parquet scan of, as a whole, else None."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None                      # rows or columns may be others than those of the files
    files = docs.inputFiles()
    folders = {posixpath.dirname(f) for f in files}
    path = files[0] if len(files) == 1 else folders.pop() if len(folders) == 1 else None
    if path is None:
        return None
    whole = docs.sparkSession.read.parquet(path)
    return path if sorted(whole.inputFiles()) == sorted(files) and whole.dtypes == docs.dtypes else None


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256, state: str | None = None) -> DataFrame:
    """One row per document under ``path``: doc_id, locator, keep_id,
    keep_locator, group_size, kept, digest."""
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, locator struct<file:string,row:bigint>, keep_id bigint, "
                                         "keep_locator struct<file:string,row:bigint>, group_size bigint, kept boolean, digest string")
    held = store(update_state(spark, path, state or scratch_path(spark, "dedup-state"), id_col, text_col, digest),
                 "dedup-held")
    total = held.agg(F.sum("group_size")).first()[0]
    seen = _arrivals(docs, id_col, text_col, digest)
    spread = F.col("locator.row")

    # rows that hit a digest held by another row: compare full bytes with the row that stays
    multi = held.where("group_size > 1").withColumn(
        "salts", F.ceil(F.col("group_size") * F.greatest("top.n_bytes", F.lit(1)) / F.lit(COMPARE_BYTES)).cast("int"))
    hits = store(lookup(seen, multi, "digest", "group_size", total, spread).where("group_size is not null"), "dedup-hits")
    is_top = F.col("locator") == F.col("top.locator")
    held_text = (hits.where(is_top).select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                           F.col("text").alias("held_text")))
    compared = (hits.where(~is_top).withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int"))
                .join(held_text, ["digest", "salt"]).where(F.col("text") != F.col("held_text")))
    strays = store(compared.select("doc_id", "locator", "digest", "text"), "dedup-strays")

    groups = held.select("digest", F.struct("top.doc_id", "top.locator").alias("keep"), "group_size")
    out = lookup(seen.drop("text"), groups, "digest", "group_size", total, spread)
    if not strays.isEmpty():
        lost = strays.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        classes = strays.groupBy("digest", "text").agg(
            F.max(F.struct("doc_id", "locator")).alias("own_keep"), F.count(F.lit(1)).alias("own_size"))
        own = strays.join(classes, ["digest", "text"]).select("locator", "own_keep", "own_size")
        out = (out.join(lost, "digest", "left").join(own, "locator", "left")
               .withColumn("keep", F.coalesce("own_keep", "keep"))
               .withColumn("group_size", F.coalesce("own_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))))
    return out.select("doc_id", "locator", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"),
                      "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest")


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that a copy with a larger id replaces."""
    path = scan_path(docs)
    if path is None:
        path = scratch_path(spark, "dedup-arrivals")
        docs.write.parquet(path)
    kept = exact_dedup(spark, path).where("kept").select("locator.file", "locator.row")
    src = spark.read.parquet(path)
    rows = src.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(kept, (F.col("__file") == kept["file"]) & (F.col("__row") == kept["row"]), "left_semi").select(*docs.columns)


@query("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return got.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
