"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most 3
bits, then from some segment on every chain of l consecutive segments differs in at most
floor(l * 3 / 4) bits: 0, 1, 2, 3. Fingerprints are dealt by (segment, value), which settles
chains of one; in a task, chains of two are looked up by value, chains of three are tested on
what remains, and only survivors get the full Hamming test.

Equal fingerprints are one node. A (segment, value) with very many nodes is dealt as a grid of
blocks, every pair of blocks meeting in one task. Tasks return a spanning forest of the links
they find, never all pairs.

Defined results: a null or blank text has fingerprint zero and links like any other; very long texts
are hashed whole, a bounded number of shingles at a time; doc_id may be null or repeated (the smallest
non-null one names a component; of rows that tie, the one that comes first in its file stays);
repeated rows are one node; an empty table gives no rows; other columns are ignored, or carried along
by ``keep_one_of_each``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import FILE, LOWER_BYTES, ROW, connected_components, located, materialize, merge_labels, pair_blocks, shuffle_partitions, slices, stable, table, without

SEED, SEGMENTS, BITS, MAX_DIFF = 42, 4, 16, 3
HASHES_AT_ONCE, PAIRS_AT_ONCE, BLOCK = 100_000, 1_000_000, 20_000
NODES_PER_TASK = 100_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = end - size
    n = max(1, len(words) - width + 1)
    first, end = first[:n].tolist(), end[min(width, len(words)) - 1 :].tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = [h(line[a:b], SEED) for a, b in zip(first[at : at + HASHES_AT_ONCE], end[at : at + HASHES_AT_ONCE])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, locator, fp (the 64 bits as a signed long) of a located frame."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, width) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(FILE), b.column(ROW), pa.array(fp.view(np.int64))], ["doc_id", FILE, ROW, "fp"])

    return rows.select("doc_id", "text", FILE, ROW).mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, fp long")


def chain_links(key: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (indices into the sorted distinct fingerprints) of the links inside each (key, cell)."""
    nodes, node = np.unique(fp, return_inverse=True)
    labels = np.arange(len(nodes))
    pairs, group = np.unique(np.stack([key, cell]), axis=1, return_inverse=True)
    at = (pairs[0] >> BITS)[group]  # the chain's first segment
    u = fp.view(np.uint64)
    seg = lambda k: (u >> (((at + k) % SEGMENTS) * BITS).astype(np.uint64)) & np.uint64(0xFFFF)
    two = group.astype(np.int64) << BITS | seg(1).astype(np.int64)
    order = np.argsort(two, kind="stable")
    two, u, node, third = two[order], u[order], node[order], seg(2)[order].astype(np.uint16)
    value, start, size = np.unique(two, return_index=True, return_counts=True)
    for mask in [0, *(1 << k for k in range(BITS))]:
        other = np.searchsorted(value, value ^ mask)
        hit = np.flatnonzero((other < len(value)) & (value[np.minimum(other, len(value) - 1)] == value ^ mask))
        hit = hit[size[hit] > 1] if not mask else hit[hit < other[hit]]
        for a, b in pair_blocks(start[hit], size[hit], start[other[hit]], size[other[hit]], PAIRS_AT_ONCE):
            if not mask:
                a, b = a[a < b], b[a < b]
            budget = np.bitwise_count(third[a] ^ third[b]) + (mask != 0) <= 2  # chains of three
            a, b = a[budget], b[budget]
            a, b = node[a], node[b]
            near = np.bitwise_count(nodes.view(np.uint64)[a] ^ nodes.view(np.uint64)[b]) <= MAX_DIFF
            labels = merge_labels(labels, a[near], b[near])
    child = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[child], nodes[labels[child]]


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, enough to join what links join."""
    spark = distinct.sparkSession
    key = F.explode(F.array(*(F.shiftrightunsigned("fp", k * BITS).bitwiseAND(F.lit(0xFFFF)) + (k << BITS) for k in range(SEGMENTS))))
    keyed = distinct.select("fp", key.alias("key"))
    # At most 4 * 65,536 keys exist, so this side is bounded whatever the data.
    hot = keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    keyed = keyed.join(F.broadcast(hot), "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    dealt = keyed.select("fp", "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(grid)).alias("cell"))

    def run(batches):
        got = [x for b in batches for x in [(b.column("key").to_numpy(), b.column("cell").to_numpy(), b.column("fp").to_numpy())] if len(x[0])]
        if got:
            a, b = chain_links(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    parts = shuffle_partitions(spark, SEGMENTS * n, NODES_PER_TASK)
    return dealt.select(F.col("key").cast("long"), F.col("cell").cast("long"), "fp").repartition(parts, "key", "cell").mapInArrow(run, "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document row: doc_id, locator, fp, component_id, kept (one row of each component)."""
    prints = materialize(fingerprints(located(docs, "doc_id", "text"), width), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)).alias("first")
    distinct = materialize(prints.groupBy("fp").agg(first), "simhash-distinct")
    comp = connected_components(links(distinct.select("fp"), distinct.count()))
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "simhash-named")
    least = materialize(named.groupBy("component").agg(F.min("first").alias("least")), "simhash-least")
    named = materialize(named.join(least, "component").select("fp", "least"), "simhash-component")
    same = (F.col(f"least.{FILE}") == F.col(FILE)) & (F.col(f"least.{ROW}") == F.col(ROW))
    return prints.join(named, "fp").select("doc_id", FILE, ROW, "fp", F.col("least.doc_id").alias("component_id"), same.alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component (the smallest doc_id), with the columns of ``docs``."""
    docs = stable(docs)
    return without(docs, simhash_dedup(docs).where("not kept"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
