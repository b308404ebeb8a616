"""Helpers that the training-data operators share.

Shared storage: intermediate tables go under the folder that the cluster names in
``spark.checkpoint.dir``, in one folder for each application. Only where that setting is absent and
the master is a single local process (tests) is a folder of our own used; elsewhere that is an error.
Tables that only an operator's own steps read are deleted as it goes; a returned plan still reads the
others, so ``clear_scratch`` is for the caller, after the results have been written.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import string
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row set is broadcast only when its counted rows (two or three longs each) are at most this many.
BROADCAST_ROWS = 200_000

#: Rows and bytes that a Python worker handles at once: Spark bounds its batches by bytes too, but more loosely.
BATCH_ROWS, BATCH_BYTES = 2000, 6 << 20

#: Byte table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

#: DuckDB and Spark SQL expression text of the same lower-casing.
LOWER_SQL = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

FILE, ROW = "_loc_file", "_loc_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str = "text", rows: int | None = None, size: int | None = None):
    """The batches in parts of at most so many rows and about so many bytes of a column (one row at least)."""
    rows, size = rows or BATCH_ROWS, size or BATCH_BYTES
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(at, to - at)
            at = to


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/panelwright/{sc.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote; results that still read it must have been saved before."""
    discard(spark, shared_root(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(spark: SparkSession, *what: str | DataFrame) -> None:
    """Delete intermediate tables that no returned plan reads any more."""
    for x in what:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.scratch_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plain_scan(df: DataFrame) -> bool:
    """True for projections and filters over one file scan: every row then has a file and a position of its own."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and bool(df.inputFiles())


def stable(df: DataFrame, name: str = "docs") -> DataFrame:
    """``df`` where several reads give its rows the same locators; anything but a plain file scan is written once."""
    return df if plain_scan(df) else materialize(df, name)


def located(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns and a locator (file key, row in file) that is unique and stable for every row; a clash with the table's own names does no harm."""
    docs = stable(docs)
    where = docs.metadataColumn("_metadata")
    return docs.select(*columns, F.xxhash64(where["file_path"]).alias(FILE), where["row_index"].alias(ROW))


def size_checked(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a frame whose counted rows are within the bound; beyond it a shuffle join is left to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of a stable frame whose locator is not in ``dropped``, with all its columns."""
    dropped = materialize(dropped.select(FILE, ROW), "dropped")
    rows = located(docs, F.struct("*").alias("row"))
    return rows.join(size_checked(dropped, dropped.count()), [FILE, ROW], "left_anti").select("row.*")


def trim() -> None:
    """Hand freed memory of a Python worker back to the system: workers outlive tasks and stages, and share an executor's memory."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def lower_az(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shuffle_partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    Alternating large-star and small-star rounds; each round's edges are written to the shared
    folder. Minima are pre-aggregated, and joins with them read two plain exchanges, which
    adaptive execution can split when a hub holds most of the edges. Self-loops name a node of
    its own. No edge is collected; the driver sees a count and a checksum per round.
    """
    spark = edges.sparkSession
    norm = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    cur = materialize(norm(named), "cc")
    mark = None
    while True:
        both = cur.union(cur.select("b", "a"))
        low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-min")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(norm(large), "cc-large")
        mins = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-min")
        small = large.join(mins, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(mins.select("a", F.col("m").alias("b")))
        old, cur = cur, materialize(norm(small), "cc")
        discard(spark, old, low, large, mins)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b"), F.col("b")).distinct())


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the classes of a[i] and b[i]; labels[x] is the smallest index of x's class."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def pair_blocks(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray, most: int):
    """Index pairs of the rectangles [sa, sa+na) x [sb, sb+nb), at most about ``most`` at a time."""
    step = np.maximum(1, most // np.maximum(nb, 1))
    parts = -(-na // step)
    which = np.repeat(np.arange(len(sa)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    s = sa[which] + nth * step[which]
    n = np.minimum(step[which], na[which] - nth * step[which])
    load = np.cumsum(n * nb[which])
    at = 0
    while at < len(which):
        base = load[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(load, base + most, side="right")))
        w, rows = which[at:to], n[at:to]
        area = rows * nb[w]
        r = np.repeat(np.arange(len(w)), area)
        k = np.arange(len(r)) - np.repeat(np.cumsum(area) - area, area)
        yield s[at:to][r] + k // nb[w][r], sb[w][r] + k % nb[w][r]
        at = to
