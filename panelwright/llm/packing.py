"""Best-fit packing in bulk-synchronous rounds.

Lengths are integers up to the length of a sequence, so documents and gaps sorted by size are runs
of equal size. A sweep deals the runs to ranges of sizes; each range matches its documents with
their successors (the smallest gap that holds one), conflicts over a gap going to the longer
document; what a range cannot match is carried to the ranges beyond, gaps are brought up to date,
and the next sweep begins. When a sweep places nothing, the longest documents open new sequences.
State is written to the shared folder once a round of a few sweeps; the driver sees only how many
runs are left. The runs' number is bounded by sizes and sweeps, not by documents: those are ranked
within their length on the executors (a running number per task plus the counts of the tasks
before), and each meets its placement in a join on (length, block of ranks).

Defined results: a null text is empty and has the one closing id; only documents longer than
``max_len`` are cut, very long ones into many pieces; equal lengths are ranked by task and place;
repeated rows are packed each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.bytebpe import byte_letters
from panelwright.llm.codepoints import BLANK, regex_classes, unlike
from panelwright.llm.common import materialize, size_checked, slices, table, trim
from panelwright.llm.memo import HashMemo, digests, spread

WORD_BPE = "word_bpe_49k.json"
#: Fixed value: the tokenizer's word pattern, with a space as a word of its own, and what it comes to on lower-case ASCII with a line end as a word of its own.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]| |[^\p{White_Space}\p{L}\p{N}]+").findall
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^a-z0-9\n]+").findall
MAX_LEN = 2048
#: Ranks of a block, by which pieces look up their placement.
BLOCK = 4096
#: Segments that a worker remembers; a bound on memory, not on results.
SEGMENTS = 400_000
CLOSING = 0
END = b"\0"  # stands for the end-of-word suffix


def word_encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Words that end with ``END`` to ranks in one native call, and the id of every rank.

    A BPE with an end-of-word suffix is a plain byte BPE over words that end with a byte of their
    own: ranks are bytes, bytes with the suffix, then the merges in their order. Words that hold
    the byte itself are left to the library.
    """
    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix, vocab, letters = model["end_of_word_suffix"], model["vocab"], byte_letters()

    def raw(token: str) -> bytes:
        ends = token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + END * ends

    base = [c + e for e in ("", suffix) for c in letters]
    merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    ranks: dict[bytes, int] = {}
    ids = np.zeros(len(base) + len(merged), "<u4")
    for rank, token in enumerate(base + merged):
        ids[rank] = vocab[token]
        if END not in raw(token)[:-1] and token != "\u0100":
            ranks.setdefault(raw(token), rank)
    ranks[END] = len(ids)  # never left alone: every byte merges with it first
    return tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}), ids


class WordIds:
    """Ids of white-space separated segments; the tokenizer drops white space and no word spans it.

    New segments are normalised by the library, cut into words by its pattern and merged in one
    native call. Segments that hold a special string, a zero byte, white space beyond ASCII or a
    character that the library's tables class otherwise than ``regex`` (``unlike``) are encoded by
    the library whole. Segments are remembered up to a bound.
    """

    def __init__(self, path: str, unlike: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encoding, self.id_of = word_encoding(path)
        self.apart = unlike | frozenset(map(chr, np.flatnonzero(regex_classes() == BLANK).tolist())) - {" "}
        self.segments = HashMemo(SEGMENTS, "<u2" if len(self.id_of) < 1 << 16 else "<u4")

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of words, and how many stand between its marks, which are words of their own."""
        words.append("")
        rank = np.array(self.encoding.encode_ordinary("\0".join(words)), np.int64)
        words.pop()
        here = rank == self.encoding.encode_single_token(mark + "\0")
        return self.id_of[rank[~here]], np.diff(np.append(np.flatnonzero(here), len(rank)), prepend=-1) - 1

    def learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one's after the other, and how many each has."""
        n = len(segments)
        size, parts = np.zeros(n, np.int64), []
        ascii_ = np.fromiter(map(str.isascii, segments), bool, n)
        apart = np.fromiter((("<|" in s and any(t in s for t in self.special)) or "\0" in s or not (a or self.apart.isdisjoint(s)) for s, a in zip(segments, ascii_.tolist())), bool, n)
        plain, other, whole = np.flatnonzero(ascii_ & ~apart), np.flatnonzero(~ascii_ & ~apart), np.flatnonzero(apart)
        order = []
        if len(other):
            normal = WORDS(self.tokenizer.normalizer.normalize_str(" ".join([segments[k] for k in other.tolist()])))
            if normal.count(" ") == len(other) - 1:
                ids, size[other] = self.cut(normal, " ")
                parts.append(ids)
                order.append(other)
            else:
                whole = np.concatenate([whole, other])
        if len(plain):
            ids, size[plain] = self.cut(ASCII_WORDS("\n".join([segments[k] for k in plain.tolist()]).lower()), "\n")
            parts.append(ids)
            order.append(plain)
        if len(whole):
            ids = self.by_library([segments[k] for k in whole.tolist()])
            size[whole] = [len(x) // 4 for x in ids]
            parts.append(np.frombuffer(b"".join(ids), "<u4"))
            order.append(whole)
        order = np.concatenate([*order, np.zeros(0, np.int64)]).astype(np.int64)
        ids = np.concatenate([*parts, np.zeros(0, "<u4")])
        start = np.zeros(n, np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return ids[spread(start, size)], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the closing id after each, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        raw = words.dictionary.cast(pa.binary()).to_pylist()
        h = digests(raw)
        at = self.segments.find(h)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        ids, some = self.segments.take(at[old])
        learnt, more = self.learn([raw[k].decode() for k in new.tolist()])
        if len(new):
            self.segments.add(h[new], more, learnt)
        # Ids of the batch's distinct segments, the closing id last; then all segments' in their order.
        ids = np.concatenate([ids, learnt, np.array([CLOSING], "<u4")])
        size = np.zeros(len(raw) + 1, np.int64)
        size[old], size[new], size[-1] = some, more, 1
        start = np.zeros(len(raw) + 1, np.int64)
        at = np.concatenate([old, new, [len(raw)]])
        start[at] = np.cumsum(size[at]) - size[at]
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        every = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(raw))
        last = ends + np.arange(len(ends))  # of each text's segments, its closing id
        per = np.cumsum(size[every])[last]
        return ids[spread(start[every], size[every])], np.diff(per, prepend=0)


@lru_cache(maxsize=2)
def word_ids(path: str, unlike: frozenset[str]) -> WordIds:
    return WordIds(path, unlike)


def tokenizer_path(path: str | None) -> str:
    return path or public_tokenizers.path(WORD_BPE)


def pieces(docs: DataFrame, max_len: int = MAX_LEN, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and the task and running number that rank it; ids on request."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    path, apart = tokenizer_path(path), unlike(tokenizer_path(path))

    def run(batches):
        task, seen, encoder = TaskContext.get().partitionId(), Counter(), word_ids(path, apart)
        for b in slices(batches):
            ids, size = encoder.encode(b.column("text"))
            raw, count = memoryview(np.ascontiguousarray(ids)).cast("B"), -(-size // max_len)
            doc = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * max_len
            length = np.minimum(max_len, size[doc] - start)
            at = (np.cumsum(size) - size)[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(at.tolist(), (at + length).tolist())]
            nth = np.empty(len(doc), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[part[0]])
                nth[part] = seen[n] + np.arange(len(part))
                seen[n] += len(part)
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)
        trim()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def matched(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], max_len: int):
    """One sweep from long to short: every document takes the smallest gap that holds it and that no longer one has taken.

    Runs in and out: documents (size, first rank, n), gaps (size, first sequence, n); placements
    (size, first rank, n, first sequence, offset), gaps that are left over, documents left over,
    and what placements leave of their gaps. The smallest open gap is the one last met, so a stack
    is all that is needed, and sweeping ranges of sizes first and their leftovers after is the same.
    """
    placed, after, left, stack = [], [], [], []
    waiting = sorted(gaps, reverse=True)
    at = 0
    for size, first, n in sorted(docs, reverse=True):
        while at < len(waiting) and waiting[at][0] >= size:
            stack.append(waiting[at])
            at += 1
        while n and stack:
            gap, sequence, m = stack.pop()
            k = min(m, n)
            if k < m:
                stack.append((gap, sequence + k, m - k))
            placed.append((size, first, k, sequence, max_len - gap))
            if gap > size:
                after.append((gap - size, sequence, k))
            first, n = first + k, n - k
        if n:
            left.append((size, first, n))
    return placed, stack + waiting[at:], left, after


def opened(docs: list[tuple[int, int, int]], sequences: int, max_len: int):
    """New sequences for what no gap holds: one for every document longer than half, else as many as the tokens fill, for the longest."""
    placed, after, left = [], [], []
    big = any(2 * size > max_len for size, _, _ in docs)
    need = sum(n for size, _, n in docs if 2 * size > max_len) if big else -(-sum(size * n for size, _, n in docs) // max_len)
    for size, first, n in sorted(docs, reverse=True):
        k = min(n, need)
        need -= k
        if k:
            placed.append((size, first, k, sequences, 0))
            if size < max_len:
                after.append((max_len - size, sequences, k))
            sequences += k
        if k < n:
            left.append((size, first + k, n - k))
    return placed, after, left, sequences


#: Kinds of a round's rows; PUT and LEFT are placements and gaps of the sweep that is under way.
DOCS, GAPS, PLACED, OPENED, PUT, LEFT = range(6)
STATE = "part int, kind int, size int, first long, n long, sequence long, offset int"


def state_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in STATE.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def swept(state: DataFrame, max_len: int, width: int) -> DataFrame:
    """One sweep: ranges of sizes side by side, then what they leave, carried from range to range; gaps are brought up to date."""

    def runs(tbl: pa.Table):
        rows: dict[int, list[tuple]] = {k: [] for k in range(6)}
        for part, kind, size, first, n, sequence, offset in zip(*(c.to_pylist() for c in tbl.columns)):
            rows[kind].append((size, sequence, n) if kind in (GAPS, LEFT) else (size, first, n, sequence, offset)[: 3 if kind == DOCS else 5])
        return rows

    def table(part, docs, gaps, **others) -> pa.Table:
        out = [(part(s), DOCS, s, f, n, 0, 0) for s, f, n in docs]
        for kind, some in ((GAPS, gaps), (LEFT, others.get("after", ()))):
            out += [(part(s), kind, s, 0, n, q, 0) for s, q, n in some]
        for kind in (PLACED, OPENED, PUT):
            out += [(0, kind, *r) for r in others.get("rows", {}).get(kind, ())]
        return state_table(out)

    def in_range(tbl):
        rows = runs(tbl)
        placed, gaps, docs, after = matched(rows[DOCS], rows[GAPS], max_len)
        return table(lambda s: 0, docs, gaps, after=after + rows[LEFT], rows=rows | {PUT: rows[PUT] + placed})

    def carried(tbl):
        rows = runs(tbl)
        placed, gaps, docs, after = matched(rows[DOCS], rows[GAPS], max_len)
        placed, after = placed + rows[PUT], after + rows[LEFT]
        sequences = max((r[2] for r in rows[OPENED]), default=0)
        if docs and not placed:
            placed, after, docs, sequences = opened(docs, sequences, max_len)
        return table(lambda s: s // width, docs, gaps + after, rows={PLACED: rows[PLACED] + placed, OPENED: [(0, 0, sequences, 0, 0)]})

    return state.groupBy("part").applyInArrow(in_range, STATE).groupBy("part").applyInArrow(carried, STATE)


def rounds(counts: DataFrame, max_len: int, width: int = 128, sweeps: int = 4) -> DataFrame:
    """Placements (size, first, n, sequence, offset): documents of a size by rank to consecutive sequences.

    ``counts``: documents (n) of every size. State is runs of equal size, at most ``max_len`` of
    documents, and is written once a round of ``sweeps``; the driver sees how many are left.
    """
    spark = counts.sparkSession
    zero = lambda kind: F.lit(0).cast(kind)
    state = counts.select(F.floor(F.col("size") / width).cast("int").alias("part"), zero("int").alias("kind"), F.col("size").cast("int"), zero("long").alias("first"), F.col("n").cast("long"), zero("long").alias("sequence"), zero("int").alias("offset"))
    placed = None
    while True:
        for _ in range(sweeps):
            state = swept(state, max_len, width)
        state = materialize(state, "packing-round")
        some = state.where(F.col("kind") == PLACED).select("size", "first", "n", "sequence", "offset")
        placed = some if placed is None else placed.union(some)
        if not state.where(F.col("kind") == DOCS).count():
            return materialize(placed, "placements")
        state = state.where(F.col("kind") != PLACED)


def pack(docs: DataFrame, max_len: int = MAX_LEN, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    made = materialize(pieces(docs, max_len, path, with_ids), "pieces")
    counts = materialize(made.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = materialize(counts.select("task", "length", before.alias("before")), "piece-ranks")
    made = made.join(size_checked(ranked, ranked.count()), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = rounds(counts.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")), max_len)
    # A run of ranks is cut where blocks of ranks end, so that pieces of one length, however many, meet theirs all over the cluster.
    last = F.col("first") + F.col("n") - 1
    blocks = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))))
    blocks = materialize(blocks.select(F.col("size").cast("long").alias("length"), "block", "first", last.alias("last"), "sequence", "offset"), "placement-blocks")
    made = made.withColumn("block", F.floor(F.col("rank") / BLOCK))
    out = made.join(size_checked(blocks, blocks.count()), ["length", "block"]).where("rank between first and last")
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, F.col("offset").cast("long").alias("offset"), *["ids"] * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
