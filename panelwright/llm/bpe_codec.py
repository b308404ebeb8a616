"""BPE encoding by speculation and verification, and decoding.

Greedy longest match over the vocabulary proposes the tokens of every new word of a batch; one
vectorised check tests all adjacent pairs of all proposals for compatibility (a pair is compatible
if merging its bytes gives the pair again, and a word whose pairs all are is encoded right); only
failing words undergo exact merging. Words are remembered by the worker up to a bound. Texts with a
character that the library's tables class otherwise than those used here (``codepoints.unlike``) are
cut into words by the library's own pre-tokenizer.

Defined results: a null text is empty and has no tokens; special strings in a text become their
id, as the library has it by default, and are kept by decoding; repeated rows are encoded each;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.bytebpe import MEMO, ByteBpe, byte_bpe, split_special, tokenizer_path
from panelwright.llm.codepoints import unlike
from panelwright.llm.common import slices, table

#: Fixed value: the word pattern of the byte-level pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
CHARS_AT_ONCE = 2_000_000


class Codec:
    def __init__(self, bpe: ByteBpe, path: str, unlike: frozenset[str]):
        self.bpe, self.path, self.unlike, self.pre = bpe, path, unlike, None
        self.ids_of: dict[str, bytes] = {}
        self.pair_key = np.zeros(0, np.int64)  # sorted, with the verdict of each
        self.pair_good = np.zeros(0, bool)
        self.special = {i: np.array([i], "<u4").tobytes() for i in bpe.special.values()}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        child, token = self.bpe.child, self.bpe.token
        out, at, n = [], 0, len(word)
        while at < n:
            node, k, best, to = 0, at, -1, at
            while k < n:
                node = child[node].get(word[k])
                if node is None:
                    break
                k += 1
                if token[node] >= 0:
                    best, to = token[node], k
            out.append(best)
            at = to
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of every pair key (a << 20 | b)."""
        at = np.searchsorted(self.pair_key, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.pair_key)
        known[inside] = self.pair_key[at[inside]] == keys[inside]
        if not known.all():
            new = np.unique(keys[~known])
            if len(self.pair_key) > 2 * MEMO:
                self.pair_key, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(keys)
            exact, token = self.bpe.exact, self.bpe.bytes
            good = np.fromiter((exact(token[k >> 20] + token[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF] for k in new.tolist()), bool, len(new))
            order = np.argsort(all_keys := np.concatenate([self.pair_key, new]))
            self.pair_key, self.pair_good = all_keys[order], np.concatenate([self.pair_good, good])[order]
        return self.pair_good[np.searchsorted(self.pair_key, keys)]

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.propose(w) for w in raw]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        end = np.cumsum(size)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[end[:-1] - 1] = False
        at = np.flatnonzero(inner)
        wrong = at[~self.verified(flat[at] << 20 | flat[at + 1])]
        for k in np.unique(np.searchsorted(end, wrong, side="right")).tolist():
            ids[k] = self.bpe.exact(raw[k])
        self.ids_of |= {w: np.array(x, "<u4").tobytes() for w, x in zip(words, ids)}

    def cut(self, text: str) -> list[str]:
        if text.isascii() or self.unlike.isdisjoint(text):
            return WORDS.findall(text)
        if self.pre is None:
            from tokenizers import Tokenizer

            self.pre = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            parts, chars = [], 0
            while at < len(texts) and chars < CHARS_AT_ONCE:
                text = texts[at] or ""
                parts.append([x if isinstance(x, int) else self.cut(x) for x in split_special(text, self.bpe.special)])
                chars += len(text)
                at += 1
            if len(self.ids_of) > MEMO:
                self.ids_of.clear()
            seen = set().union(*(x for p in parts for x in p if not isinstance(x, int)))
            self.learn([w for w in seen if w not in self.ids_of])
            get = self.ids_of.__getitem__
            out += [b"".join(y for x in p for y in ([self.special[x]] if isinstance(x, int) else map(get, x))) for p in parts]
        return out

    def decode(self, ids: bytes) -> str:
        token = self.bpe.bytes
        return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, unlike: frozenset[str]) -> Codec:
    return Codec(byte_bpe(path), path, unlike)


def here(path: str | None = None) -> tuple[str, frozenset[str]]:
    """What ``codec`` takes; worked out once on the driver."""
    path = tokenizer_path(path)
    return path, unlike(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    which = here(path)

    def run(batches):
        for b in slices(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec(*which).encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""
    which = here(path)

    def run(batches):
        for b in batches:
            text = [None if x is None else codec(*which).decode(np.array(x, "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; encodes and decodes without moving ids between processes."""
    which = here(path)

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches):
            c = codec(*which)
            ids = c.encode(b.column("text").to_pylist())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            back = pa.array([sha(c.decode(x).encode()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(map(sha, ids), pa.string()), back], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe_codec": op5_bpe_codec}
ORACLES: dict[str, str] = {}
