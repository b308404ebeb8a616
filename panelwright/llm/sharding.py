"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots; rows and bytes are aggregated per
slot (a table as large as the number of slots, whatever the data); a versioned slot-to-shard map
is fitted to the slots' bytes and stored as Parquet. Rebalancing edits the latest map: it moves
whole slots and adds a version, and records never change their slot.

Defined results: a record's size is the UTF-8 bytes of its text (null: none) plus 8; the slot hash
covers doc_id, text and, for rows that are equal in both, their running number, so one row repeated
however often spreads evenly too (which of equal rows has which number is open, they are
interchangeable). Very long texts weigh what they are. An empty table gives no rows; extra columns
are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import materialize, scratch, size_checked, table

SLOTS = 8192
SHARDS = 24
KEY = ("doc_id", "text_crc32", "size")


def virtual_slot(slots: int = SLOTS) -> Column:
    """First rows of their key hash by the key alone, further ones by their number too."""
    first = F.xxhash64(*KEY)
    return F.pmod(F.when(F.col("occurrence") == 0, first).otherwise(F.xxhash64(first, "occurrence")), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every record.

    Equal rows are numbered: within each task by a window over (key, task), whose groups are no
    larger than a task, after the counts of the tasks before.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    d = materialize(d.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sized")
    per = d.groupBy(*KEY, "task").agg(F.count("*").alias("n"))
    often = materialize(per.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n > 1").select(F.xxhash64(*KEY).alias("key")).distinct(), "repeated")
    n = often.count()
    if not n:
        return d.withColumn("occurrence", F.lit(0).cast("long")).withColumn("virtual_slot", virtual_slot(slots)).drop("task", "at", "occurrence")
    d = d.withColumn("key", F.xxhash64(*KEY))
    # A key that many rows share is on both sides of these joins once per task at most, or read from a plain exchange that can be split.
    once = d.join(size_checked(often, n), "key", "left_anti").withColumn("occurrence", F.lit(0).cast("long"))
    more = d.join(size_checked(often, n), "key", "left_semi")
    counts = more.groupBy("key", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("key", "task", before.alias("before"))
    nth = F.row_number().over(W.partitionBy("key", "task").orderBy("at")) - 1
    more = more.withColumn("nth", nth).join(counts, ["key", "task"]).withColumn("occurrence", (F.col("before") + F.col("nth")).cast("long"))
    both = once.select(*KEY, "occurrence").union(more.select(*KEY, "occurrence"))
    return both.withColumn("virtual_slot", virtual_slot(slots)).select("doc_id", "size", "text_crc32", "virtual_slot")


def slot_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def balance(stats: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of every slot: largest slots first, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-stats.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + stats.get(slot, 0), shard))
    return out


def rebalance(current: list[int], stats: dict[int, int], shards: int) -> list[int]:
    """Edit a map for new sizes or a new shard count: move as few slots as even loads need, largest that fit first."""
    out = list(current)
    load = [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += stats.get(slot, 0)
    target = sum(stats.values()) / shards
    orphans = [s for s in range(len(out)) if out[s] >= shards]
    for slot in sorted(range(len(out)), key=lambda s: (-stats.get(s, 0), s)):
        size = stats.get(slot, 0)
        if out[slot] < shards and size and load[out[slot]] - size >= target and min(load) + size <= target:
            load[out[slot]] -= size
            out[slot] = load.index(min(load))
            load[out[slot]] += size
    for slot in sorted(orphans, key=lambda s: (-stats.get(s, 0), s)):
        out[slot] = load.index(min(load))
        load[out[slot]] += stats.get(slot, 0)
    return out


class SlotMap:
    """Versions of a slot-to-shard map in a shared folder; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def latest(self) -> int:
        """The highest version; 0 without any."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([0, *(int(n[1:]) for n in names if n.startswith("v"))])

    def put(self, version: int, shard_of: list[int], shards: int) -> None:
        rows = [(version, shards, json.dumps(shard_of))]
        self.spark.createDataFrame(rows, "version int, shards int, map string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v{version:08d}")

    def get(self, version: int) -> list[int]:
        return json.loads(self.spark.read.parquet(f"{self.path}/v{version:08d}").first()["map"])

    def fit(self, stats: dict[int, int], shards: int, slots: int) -> list[int]:
        """The map for these sizes: the latest version edited, or a first one; a version is added only if it differs."""
        version = self.latest()
        old = self.get(version) if version else None
        new = rebalance(old, stats, shards) if old and len(old) == slots else balance(stats, shards, slots)
        if new != old:
            self.put(version + 1, new, shards)
        return new


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (the record's place in its shard, gapless from 0).

    ``path``: folder of the map's versions; the latest is read, edited where sizes or the number of
    shards ask for it, and a new version stored. Without it every run fits a first version.
    """
    spark = docs.sparkSession
    records = materialize(sized(docs, slots), "slotted")
    stats = slot_stats(records).collect()  # at most ``slots`` rows
    shard_of = SlotMap(spark, path or scratch(spark, "slot-map")).fit({r["virtual_slot"]: r["bytes"] for r in stats}, shards, slots)
    rows = {r["virtual_slot"]: r["rows"] for r in stats}
    start, filled = [], [0] * shards
    for s in range(slots):
        start.append((s, shard_of[s], filled[shard_of[s]]))
        filled[shard_of[s]] += rows.get(s, 0)
    slot_map = spark.createDataFrame(start, "virtual_slot int, shard int, first long")  # exactly ``slots`` rows
    place = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*KEY)) - 1
    return records.withColumn("place", place).join(F.broadcast(slot_map), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("place")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shard(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
