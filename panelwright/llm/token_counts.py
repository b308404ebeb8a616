"""Token counts from compiled finite-state transducers.

Two deterministic transducers are compiled from a byte-level BPE tokenizer. The first reads
character classes, as the tokenizer's own pre-tokenizer has them, and marks where words begin; text
is cut into chunks of equal length, every chunk's map from entry state to exit state is computed in
lock step, the maps are composed by a parallel prefix scan, and a second pass from the known entry
states writes the marks. The second reads the bytes of a word; a state holds the open vocabulary
prefixes with the last token before each, and every transition is annotated with the change in
emitted tokens. Its transitions are compiled when first taken and kept by the worker. The byte
transducer starts anew with each word, so only word boundaries need the scan: emitted counts are
added up over a text by a prefix sum, not carried through the chunk maps.

Defined results: a null text is empty and has no tokens; special strings in a text count as one
token, as the library has it by default; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.bytebpe import MEMO, ByteBpe, byte_bpe, split_special, tokenizer_path
from panelwright.llm.codepoints import BLANK as WHITE
from panelwright.llm.codepoints import LETTER as LETTERS
from panelwright.llm.codepoints import NUMBER as NUMBERS
from panelwright.llm.codepoints import library_classes
from panelwright.llm.common import slices, table

LIMIT = 512
CHUNK = 128
CHARS_AT_ONCE = 1_000_000
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E, END = range(12)
OPEN, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
HERE, BEFORE = 1, 2


def packed_classes(path: str) -> bytes:
    """The tokenizer's code point classes, small enough to go with every task."""
    return zlib.compress(library_classes(path).tobytes())


@lru_cache(maxsize=2)
def char_classes(packed: bytes) -> np.ndarray:
    kind = np.frombuffer(zlib.decompress(packed), np.uint8)
    out = np.full(len(kind), OTHER, np.uint8)
    for a, b in ((LETTERS, LETTER), (NUMBERS, NUMBER), (WHITE, BLANK)):
        out[kind == a] = b
    for chars, b in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in chars]] = b
    return out


@lru_cache(maxsize=1)
def word_starts_machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state * 16 + class] and marks (a word begins HERE, or began one character BEFORE)."""
    nxt, marks = np.zeros(192, np.uint8), np.zeros(192, np.uint8)
    run = {LETTER: WORD, STMD: WORD, R: WORD, V: WORD, L: WORD, E: WORD, NUMBER: DIGITS, OTHER: SIGNS, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: OPEN}
    letters = {LETTER, STMD, R, V, L, E}
    for state in range(12):
        for kind in range(12):
            to, mark = run[kind], HERE
            if state == WORD and kind in letters or state == DIGITS and kind == NUMBER:
                mark = 0
            elif state == SIGNS and kind in (OTHER, QUOTE):
                to, mark = SIGNS, 0
            elif state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
                if kind in (SPACE, BLANK):
                    to, mark = (MORE_SPACE if kind == SPACE else MORE_BLANK), 0
                elif kind != END:
                    mark = BEFORE if state in (MORE_SPACE, MORE_BLANK) else 0
                    if state in (ONE_SPACE, MORE_SPACE):
                        to = SIGNS if kind == QUOTE else to
                    else:
                        mark |= HERE
            elif state == QUOTED:
                if kind == STMD:
                    to, mark = OPEN, 0
                elif kind in (R, V, L):
                    to, mark = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
                elif kind in (OTHER, QUOTE):
                    to, mark = SIGNS, 0
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L):
                if kind == (L if state == QUOTED_L else E):
                    to, mark = OPEN, 0
                else:
                    mark = BEFORE | (0 if kind in letters else HERE)
            nxt[state * 16 + kind], marks[state * 16 + kind] = to, 0 if kind == END else mark
            if kind == END and state in (QUOTED_R, QUOTED_V, QUOTED_L):
                marks[state * 16 + kind] = BEFORE
    return nxt, marks


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the rows of ``maps`` (chunk, entry state) -> exit state."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d], axis=1)
        d *= 2
    return out


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which words begin in a string of classes whose texts end with END."""
    nxt, marks = word_starts_machine()
    n = len(kinds)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[None], rows, axis=0)
    for k in range(CHUNK):
        maps = nxt[maps * 16 + grid[k][:, None]]
    entry = np.concatenate([[OPEN], compose_scan(maps)[:-1, OPEN]]).astype(np.uint8)
    out = np.empty((CHUNK, rows), np.uint8)
    for k in range(CHUNK):
        at = entry * 16 + grid[k]
        out[k], entry = marks[at], nxt[at]
    flat = out.T.reshape(-1)[:n]
    begins = (flat & HERE) != 0
    begins[:-1] |= (flat[1:] & BEFORE) != 0
    return np.flatnonzero(begins)


class WordCounts(dict):
    """Tokens of a word by the compiled byte transducer; remembers words up to a bound."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.reset()

    def reset(self) -> None:
        #: A state: (trie node, last token before it or -1, tokens before it less tokens so far) of every open prefix.
        self.states: list[tuple] = []
        self.state_of: dict[tuple, int] = {}
        self.step: dict[int, tuple[int, int]] = {}
        self.start = self.state(((0, -1, 0),))

    def state(self, key: tuple) -> int:
        at = self.state_of.get(key)
        if at is None:
            at = self.state_of[key] = len(self.states)
            self.states.append(key)
        return at

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        bpe, last, count, still = self.bpe, -1, 0, []
        for node, before, d in self.states[state]:
            to = bpe.child[node].get(byte)
            if to is None:
                continue
            if bpe.child[to]:
                still.append((to, before, d))
            t = bpe.token[to]
            if t >= 0 and last < 0 and (before < 0 or bpe.compatible(before, t)):
                last, count = t, d + 1
        key = tuple((node, before, d - count) for node, before, d in still) + ((0, last, 0),)
        made = self.step[state << 8 | byte] = self.state(key), count
        return made

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        if len(self.states) > MEMO // 2 or len(self.step) > MEMO:
            self.reset()
        state, total, get = self.start, 0, self.step.get
        for b in word.encode("utf-8", "surrogatepass"):
            state, change = get(state << 8 | b) or self.compile(state, b)
            total += change
        self[word] = total
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounts:
    return WordCounts(byte_bpe(path))


def count_tokens(texts: list[str | None], path: str, packed: bytes) -> list[int]:
    counts, classes = counter(path), char_classes(packed)
    special = counts.bpe.special
    total = [0] * len(texts)
    parts: list[str] = []
    owner: list[int] = []
    chars = 0

    def flush() -> None:
        nonlocal chars
        if parts:
            line = "\0".join(parts) + "\0"
            kinds = classes[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(size + 1) - 1
            kinds[ends] = END
            begins = word_starts(kinds)
            stops = np.minimum(np.append(begins[1:], len(line)), ends[np.searchsorted(ends, begins)])
            got = np.fromiter(map(counts.__getitem__, [line[a:b] for a, b in zip(begins.tolist(), stops.tolist())]), np.int64, len(begins))
            for k, n in zip(owner, np.diff(np.concatenate([[0], np.cumsum(got)])[np.concatenate([[0], np.searchsorted(begins, ends)])]).tolist()):
                total[k] += n
        parts.clear()
        owner.clear()
        chars = 0

    for k, text in enumerate(texts):
        for x in split_special(text or "", special):
            if isinstance(x, int):
                total[k] += 1
            else:
                parts.append(x)
                owner.append(k)
                chars += len(x) + 1
        if chars >= CHARS_AT_ONCE:
            flush()
    flush()
    return total


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = tokenizer_path(path)
    packed = packed_classes(path)

    def run(batches):
        for b in slices(batches):
            text = b.column("text").to_pylist()
            n = np.array(count_tokens(text, path, packed), np.int64)
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
