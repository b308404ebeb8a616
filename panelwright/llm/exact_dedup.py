"""Exact deduplication with a disk-backed streaming state.

Arrivals (digest, identifier, content locator) stream into a keyed aggregation whose RocksDB
state never expires: per digest it retains the stable identifier and locator of the row that
stays and the number of rows seen. Copies are combined inside each task before they are dealt
to the state, so a digest that a third of all rows share costs one row a task. Digests that were
hit again have their full bytes compared; texts that differ under one digest are told apart.

Defined results: a null text is empty; letters A-Z are folded, nothing else; among equal texts the
largest doc_id stays (nulls lowest), of rows with the same doc_id the one with the largest locator,
so exactly one row of a group has kept = true; very long texts are digested and compared whole; an
empty table gives an empty result; other columns are ignored, or carried along by
``keep_first_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import FILE, LOWER_BYTES, LOWER_SQL, ROW, discard, located, lower_az, materialize, scratch, size_checked, slices, stable, table, without

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _normal(text: pa.Array) -> list[bytes]:
    return [(t or b"").translate(LOWER_BYTES) for t in text.cast(pa.binary()).to_pylist()]


def arrivals(rows: DataFrame, digest_chars: int = 64) -> DataFrame:
    """(doc_id, locator, digest): the projection of a located frame that the stream reads."""

    def digest(batches):
        for b in slices(batches):
            d = [hashlib.sha256(t).hexdigest()[:digest_chars] for t in _normal(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(FILE), b.column(ROW), pa.array(d, pa.string())], ["doc_id", FILE, ROW, "digest"])

    return rows.select("doc_id", "text", FILE, ROW).mapInArrow(digest, f"doc_id long, {FILE} long, {ROW} long, digest string")


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful operator: one row per digest with the row that stays and the rows seen so far."""
    return stream.groupBy("digest").agg(F.max(F.struct("doc_id", FILE, ROW)).alias("keep"), F.count("*").alias("group_size"))


def run_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int, home: str | None = None) -> DataFrame:
    """Drain the arrivals table through the keyed state; every batch's changed keys are written once by batch id.

    With ``home`` the state is kept there, and a later call takes only the files that have arrived since.
    """
    out = f"{home}/updates" if home else scratch(spark, "dedup-updates")
    conf = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
        check = f"{home}/state" if home else scratch(spark, "dedup-state")
        query = (
            keyed_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", check)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in conf.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not home:
        discard(spark, check)
    state = f"digest string, keep struct<doc_id: long, {FILE}: long, {ROW}: long>, group_size long"
    spark.createDataFrame([], state).write.mode("overwrite").parquet(f"{out}/batch=-1")
    return spark.read.schema(state).parquet(out).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, max_files_per_trigger: int = 256, digest_chars: int = 64) -> DataFrame:
    """One row per document row: doc_id, locator, digest, keep (struct), group_size, kept."""
    spark = docs.sparkSession
    rows = located(docs, "doc_id", "text")
    seen = materialize(arrivals(rows, digest_chars), "dedup-arrivals")
    path = seen.inputFiles()[0].rpartition("/")[0] if seen.inputFiles() else None
    if path is None:
        return seen.select("*", F.lit(None).cast(f"struct<doc_id: long, {FILE}: long, {ROW}: long>").alias("keep"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    state = materialize(run_stream(spark, path, seen.schema, max_files_per_trigger), "dedup-final")

    # Full bytes of every hit: equal (digest, text) rows meet in one aggregate, combined in each task first.
    hit = state.where("group_size > 1").select("digest")
    n_hit = hit.count()
    hit_rows = seen.select("digest", FILE, ROW).join(size_checked(hit, n_hit), "digest", "left_semi")
    n_rows = hit_rows.count() if n_hit else 0
    texts = rows.select("doc_id", "text", FILE, ROW).join(size_checked(hit_rows, n_rows), [FILE, ROW])
    texts = texts.withColumn("text", lower_az(F.col("text")))
    exact = texts.groupBy("digest", "text").agg(F.max(F.struct("doc_id", FILE, ROW)).alias("keep"), F.count("*").alias("group_size"))
    if n_hit:
        clash = materialize(exact.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "dedup-clash")
        n_clash = clash.count()
    else:
        n_clash = 0
    out = seen.join(state, "digest")
    if n_clash:
        split = texts.join(size_checked(clash, n_clash), "digest", "left_semi")
        groups = exact.join(size_checked(clash, n_clash), "digest", "left_semi")
        split = split.join(groups, ["digest", "text"]).select(*out.columns)
        out = out.join(size_checked(clash, n_clash), "digest", "left_anti").unionByName(split)
    same = (F.col(f"keep.{FILE}") == F.col(FILE)) & (F.col(f"keep.{ROW}") == F.col(ROW))
    return out.withColumn("kept", same)


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    docs = stable(docs)
    decisions = exact_dedup(docs)
    return without(docs, decisions.where("not kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = exact_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256, {LOWER_SQL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, text_sha256
FROM d
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": ORACLE}
