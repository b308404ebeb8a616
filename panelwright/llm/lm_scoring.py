"""Language-model scoring with an Elias-Fano n-gram trie of order 3.

All training documents are counted: words first, then triples. Level 1 holds the words (hashes as a
monotone sequence, counts as differences of another) in parts by hash range. Levels 2 and 3 are
dealt into shards by context; a context that is very frequent is dealt over several shards by its
successor. A shard holds its contexts, their successors made monotone by their context's rank above
the word's bits, so that the selected high part is the pointer to a context's range, and discounted
probabilities quantised to 8 bits; a pair that is itself the context of kept triples has its place
in the shard's third level, whose successors are made monotone by that place. Every look-up is a
successor search relative to its context; a batch finds each of its contexts once.
Levels are files in the shared folder, memory-mapped by the tasks where it is mounted, up to
``VOLUME`` shards joined in a file, so that a batch opens few and looks up many at once; else read
shard by shard (a bounded number is held). So a task's memory is bounded by its batch.

    P(w | u, v) = q(w | u, v) + b(u, v) * P(w | v),  P(w | v) = q(w | v) + b(v) * P(w)

q is (n - ``DISCOUNT``) / n(context), rounded down to a code; b is what the codes of the context
leave, stored as a weight of its own, so that probabilities sum to one. P(w) is the base
distribution (0.1 added to every count, one slot for unknown words). Level 3 keeps triples seen at
least ``MIN_TRIPLES`` times; the others' mass is in b. A text starts in the context of an end, and
its first token is scored as of a pair.

Defined results: a null or empty text is one end; a null doc_id counts as held out; repeated rows
count and are scored each; ties do not arise; very long texts are read whole; without training
documents every token is unknown and N and V are 0; an empty table gives no rows; extra columns are
never read, whatever their names.

Limits: words are known by 64-bit hashes; the vocabulary may have up to 2**32 - 1 words, a shard
2**31 pairs.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.common import LOWER_BYTES, discard, materialize, scratch, shuffle_partitions, slices, table, trim
from panelwright.llm.elias_fano import EliasFano, ef_build, ef_join, load, resolve, save
from panelwright.llm.memo import spread

ADD, DISCOUNT, MIN_TRIPLES = 0.1, 0.75, 2
FOLDS = 10
#: Partial word counts of a level-1 part, training tokens of a shard, occurrences beyond which a context is dealt over shards.
PART_ROWS, SHARD_TOKENS, HOT = 4_000_000, 1_000_000, 500_000
#: Bounds of what a task holds: distinct words and triples before they go on, rows and bytes of text at once, files of the trie.
WORDS_AT_ONCE, TRIPLES_AT_ONCE, ROWS_AT_ONCE, BYTES_AT_ONCE, FILES_HELD = 500_000, 800_000, 4000, 3 << 20, 256
#: Shards joined in a file of a mounted folder.
VOLUME = 128
#: Look-ups at once, which a processor's cache holds.
AT_ONCE = 16384
#: Path, words of the level-1 parts, N, shards, occurrences that make a context hot, shards in a file.
Model = tuple[str, tuple[int, ...], int, int, int, int]
LEVELS, STEP = 256, 10 / 255  # log10 from -10 to 0
WEIGHTS = (1 << 16) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
END = b""
NONE = np.uint64(0xFFFFFFFF)  # stands after a text's end
LOW32 = np.uint64(0xFFFFFFFF)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def shard_of(c: np.ndarray, w: np.ndarray, n_c: np.ndarray, shards: int, hot: int) -> np.ndarray:
    spread = np.maximum(1, -(-n_c // hot)).astype(np.uint64)
    return nth_shard(c, w.astype(np.uint64) % spread, shards)


def nth_shard(c: np.ndarray, k: np.ndarray, shards: int) -> np.ndarray:
    return (((c.astype(np.uint64) + np.uint64(1)) * MIX >> np.uint64(20)) + k.astype(np.uint64)).astype(np.int64) % shards


def split_bytes(a: np.ndarray) -> bytes:
    """Byte planes, which compress better than the numbers."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def join_bytes(raw: bytes | pa.Buffer, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)))


def groups(of: np.ndarray, per: int = 1, most: int = 1 << 62):
    """Positions of each value, or of each ``per`` values, values ascending; at most so many at once."""
    if not len(of):
        return ()
    order = np.argsort(of.astype(np.uint16) if of.max() < 1 << 16 else of, kind="stable")  # short numbers are sorted by their digits
    cuts = np.flatnonzero(np.diff(of[order] // per)) + 1
    return np.split(order, cuts if most >= len(of) else np.union1d(cuts, np.arange(most, len(of), most)))


def by_pair(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Order by key, then x (below 2**32): two plain sorts, which vectorise, in place of a stable one."""
    order = np.argsort(key)
    nth = np.cumsum(np.append(False, np.diff(key[order]) > 0)[: len(key)])
    return order[np.argsort(nth.astype(np.uint64) << np.uint64(32) | x[order].astype(np.uint64))]


def code_of(p: np.ndarray) -> np.ndarray:
    """The code at or below a probability; 0 is less than any that is kept."""
    return np.clip(np.floor(np.log10(np.maximum(p, 1e-300)) / STEP + 1e-9) + LEVELS - 1, 0, LEVELS - 1).astype(np.uint8)


def of_code(code: np.ndarray) -> np.ndarray:
    return OF_CODE[code]


OF_CODE = np.where(np.arange(LEVELS) > 0, 10.0 ** ((np.arange(LEVELS) - (LEVELS - 1.0)) * STEP), 0.0)


class Trie:
    """The levels. ``parts``: words of each level-1 part; totals N and V."""

    def __init__(self, path: str, parts: tuple[int, ...], n: int, shards: int, hot: int, per: int):
        self.per = per
        self.path, self.offset, self.n, self.v, self.shards, self.hot = path, np.append(0, np.cumsum(parts)).astype(np.int64), n, sum(parts), shards, hot
        self.bits = np.uint64(self.v.bit_length())
        self.levels: OrderedDict[str, dict] = OrderedDict()

    def level(self, name: str) -> dict:
        if name in self.levels:
            self.levels.move_to_end(name)
        else:
            if len(self.levels) >= FILES_HELD:
                self.levels.popitem(last=False)
            a = load(f"{self.path}/{name}")
            self.levels[name] = {k: EliasFano(a, k) for k in {x.partition(".")[0] for x in a if "." in x}} | {k: x for k, x in a.items() if "." not in k}
        return self.levels[name]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of every hash."""
        ids, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        parts = len(self.offset) - 1
        order = np.argsort(h)  # parts are ranges, and sorted look-ups are near each other
        for at in np.split(order, np.flatnonzero(np.diff(part_of(h[order], parts))) + 1) if self.v and len(h) else ():
            p = int(part_of(h[at[:1]], parts)[0])
            if self.offset[p + 1] == self.offset[p]:
                continue
            lv = self.level(f"words-{p}")
            i = lv["hash"].find(h[at])
            at, i = at[i >= 0], i[i >= 0]
            ids[at] = self.offset[p] + i
            count[at] = (lv["count"].get(i + 1) - lv["count"].get(i)).astype(np.int64)
        return ids, count

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids."""
        out = np.zeros(len(ids), np.int64)
        for at in groups(np.searchsorted(self.offset, ids, side="right") - 1):
            p = int(np.searchsorted(self.offset, ids[at[0]], side="right") - 1)
            ef = self.level(f"words-{p}")["count"]
            out[at] = (ef.get(ids[at] - self.offset[p] + 1) - ef.get(ids[at] - self.offset[p])).astype(np.int64)
        return out

    def contexts(self, c: np.ndarray, n_c: np.ndarray) -> tuple[np.ndarray, ...]:
        """b of every single-word context: what the kept mass, summed over its shards, leaves. Where contexts stand: number * shards + shard, ascending, and the rank there (-1: none)."""
        per = np.maximum(1, -(-n_c // self.hot))
        which = np.repeat(np.arange(len(c)), per)
        stands = which * self.shards + nth_shard(c[which], spread(np.zeros(len(c), np.int64), per), self.shards)
        if len(stands) > len(c):
            stands = np.sort(stands)
            stands = stands[runs(stands)]  # a shard that serves one context twice counts once
        which, of = np.divmod(stands, self.shards)
        b, rank = np.ones(len(c)), np.full(len(stands), -1, np.int64)
        for at in groups(of, self.per, AT_ONCE):
            lv = self.level(f"pairs-{of[at[0]] // self.per}")
            segment = of[at] % self.per
            rank[at] = r = lv["context"].find(c[which[at]], segment)
            at, r = at[r >= 0], (r + lv["context"].first[segment])[r >= 0]
            np.subtract.at(b, which[at], lv["mass"][r].astype(float))
        return np.maximum(b, DISCOUNT / np.maximum(n_c, 1)), stands, rank  # a single successor leaves as much

    def pairs(self, k: np.ndarray, w: np.ndarray, c: np.ndarray, n_c: np.ndarray, stands: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every pair of the k-th of the contexts and w: q, b as a context of level 3 (1 where it has none), shard, place among the contexts of level 3 there (-1: none)."""
        q, b, place = np.zeros(len(k)), np.ones(len(k)), np.full(len(k), -1, np.int64)
        of = shard_of(c[k], w, n_c[k], self.shards, self.hot)
        r = rank[k if len(stands) == len(c) else np.searchsorted(stands, k * self.shards + of)]
        x = r.astype(np.uint64) << self.bits | w.astype(np.uint64)
        there = np.flatnonzero(r >= 0)
        for at in groups(of[there], self.per, AT_ONCE):
            at = there[at]
            lv = self.level(f"pairs-{of[at[0]] // self.per}")
            segment = of[at] % self.per
            i = lv["successor"].find(x[at], segment)
            at, segment, i = at[i >= 0], segment[i >= 0], i[i >= 0]
            q[at] = of_code(lv["code"][lv["successor"].first[segment] + i])
            i = lv["parent"].find(i, segment)
            at, segment, i = at[i >= 0], segment[i >= 0], i[i >= 0]
            place[at] = i
            b[at] = lv["left"][lv["parent"].first[segment] + i] / WEIGHTS
        return q, b, of, place

    def triples(self, shard: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """q of successors w of contexts of level 3."""
        q = np.zeros(len(w))
        for at in groups(shard, self.per, AT_ONCE):
            lv = self.level(f"pairs-{shard[at[0]] // self.per}")
            segment = shard[at] % self.per
            x = place[at].astype(np.uint64) << self.bits | w[at].astype(np.uint64)
            i = lv["third"].find(x, segment)
            q[at[i >= 0]] = of_code(lv["third_code"][(i + lv["third"].first[segment])[i >= 0]])
        return q


@lru_cache(maxsize=2)
def trie(path: str, parts: tuple[int, ...], n: int, shards: int, hot: int, per: int) -> Trie:
    return Trie(path, parts, n, shards, hot, per)


def tokens_of(text: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Local number of every token (texts one after the other, each with its end), the distinct words (the end last), and the tokens of each text."""
    text = pa.concat_arrays([pc.fill_null(text.cast(pa.string()), "")])  # a slice of its own, from offset 0
    _, offsets, data = text.buffers()
    lower = pa.Array.from_buffers(pa.string(), len(text), [None, offsets, pa.py_buffer(data.to_pybytes().translate(LOWER_BYTES) if data else b"")])
    split = pc.ascii_split_whitespace(lower)
    flat = split.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty piece
    ends = np.append(0, np.cumsum(real))[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
    words = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
    known = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
    ids = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(known))
    return ids, [*known, END], np.diff(ends, prepend=0) + 1


def release() -> None:
    """Hand what Arrow has freed back to the system: a worker shares an executor's memory, and Arrow's pool keeps the most it ever held."""
    pa.default_memory_pool().release_unused()


def training(batches):
    """Texts of the training documents, a bounded number at once."""
    for b in slices(batches, "text", ROWS_AT_ONCE, BYTES_AT_ONCE):
        keep = np.fromiter((fold(d) != 0 for d in b.column("doc_id").to_pylist()), bool, b.num_rows)
        if keep.any():
            yield b.column("text").filter(pa.array(keep))
            release()


def count_words(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def out():
        h, n = merged(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])

    for text in training(batches):
        ids, words, _ = tokens_of(text)
        held.append((hashes(words), np.bincount(ids, minlength=len(words))))
        waiting += len(words)
        if waiting > WORDS_AT_ONCE:
            merged_now = merged(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held[:] = [merged_now]
            waiting = len(merged_now[0])
            if 2 * waiting > WORDS_AT_ONCE:
                yield out()
                waiting = 0
    if held:
        yield out()
    trim()


def distinct(pieces, bits: int) -> tuple[np.ndarray, ...]:
    """Distinct triples of numbers of so many bits, ascending, and how often each is there."""
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    if 3 * bits <= 64:
        key = np.concatenate([(c << b | w) << b | x for c, w, x in pieces])
        key.sort()
        first = runs(key)
        n = len(key)
        key = key[first]
        c, w, x = key >> b >> b, key >> b & low, key & low
    else:  # a text of millions of distinct words
        c, w, x = map(np.concatenate, zip(*pieces))
        order = by_pair(c << np.uint64(32) | w, x)
        c, w, x, n = c[order], w[order], x[order], len(order)
        first = runs(c, w, x)
        c, w, x = c[first], w[first], x[first]
    return *(z.view(np.int64) for z in (c, w, x)), np.diff(np.append(first, n)).astype(np.uint32)


def triple_rows(t: Trie, held: list[tuple[np.ndarray, ...]]):
    """Distinct (context, word, next) of some texts (ids and counts of their words, tokens by word, tokens of each text) with their numbers, dealt to shards, as columns of byte planes."""
    known, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
    count = np.concatenate([h[1] for h in held])[at]

    def numbered():
        for ids, _, local, size in held:
            nth = np.searchsorted(known, ids).astype(np.uint64)
            w = nth[local]
            follows = np.append(w[1:], np.uint64(0))
            follows[np.cumsum(size) - 1] = len(known)
            yield contexts(w, size, nth[-1]), w, follows  # the end is the last word

    c, w, x, size = distinct(numbered(), len(known).bit_length())
    n_c, c, w = count[c], known[c].view(np.uint64), known[w].view(np.uint64)
    key, x = c << np.uint64(32) | w, np.append(known.view(np.uint64), NONE).astype(np.uint32)[x]
    of = shard_of(c, w, n_c, t.shards, t.hot)
    del n_c, c, w
    rows = [(int(of[at[0]]), split_bytes(np.diff(key[at], prepend=np.uint64(0))), split_bytes(x[at]), split_bytes(size[at])) for at in groups(of)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["shard", "keys", "next", "counts"])


def shard_arrays(key: np.ndarray, x: np.ndarray, n: np.ndarray, counts, bits: np.uint64) -> dict[str, np.ndarray]:
    """Levels 2 and 3 of a shard from its triples (context << 32 | word, next) and their numbers; ``counts`` gives words' counts, ``bits`` is what a word takes."""
    order = by_pair(key, x)
    key, x, n = key[order], x[order], n[order]
    first = runs(key, x)
    key, x, n = key[first], x[first].astype(np.uint64), np.add.reduceat(n, first) if len(first) else n
    pair = runs(key)
    of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(key))))
    total = np.add.reduceat(n, pair) if len(pair) else n
    c, w = key[pair] >> np.uint64(32), key[pair] & LOW32
    new = runs(c)
    per = np.diff(np.append(new, len(c)))
    rank = np.repeat(np.arange(len(new)), per)
    n_c = counts(c[new].astype(np.int64))
    code = code_of((total - DISCOUNT) / n_c[rank]) if len(c) else np.zeros(0, np.uint8)
    mass = np.bincount(rank, of_code(code), len(new))
    kept = np.flatnonzero((n >= MIN_TRIPLES) & (x != NONE))
    third_code = code_of((n[kept] - DISCOUNT) / total[of_pair[kept]])
    kept, third_code = kept[third_code > 0], third_code[third_code > 0]
    parent, place = np.unique(of_pair[kept], return_inverse=True)
    left = 1 - np.bincount(place, of_code(third_code), len(parent))
    out = ef_build(c[new], "context") | ef_build(rank.astype(np.uint64) << bits | w, "successor")
    out |= ef_build(parent.astype(np.uint64), "parent") | ef_build(place.astype(np.uint64) << bits | x[kept], "third")
    return out | {"code": code, "mass": mass.astype(np.float32), "left": np.clip(np.ceil(left * WEIGHTS), 1, WEIGHTS).astype(np.uint16), "third_code": third_code}


def train(docs: DataFrame) -> Model:
    """Build the levels; gives what ``trie`` takes."""
    path = scratch(docs.sparkSession, "lm-trie")
    docs = docs.select("doc_id", "text")
    partial = materialize(docs.mapInArrow(count_words, "hash long, n long"), "lm-words")
    parts = max(1, -(-partial.count() // PART_ROWS))

    def with_part(batches):
        for b in batches:
            p = part_of(b.column("hash").to_numpy().view(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(p), *b.columns], ["part", "hash", "n"])

    def build_words(key, tbl):
        h, n = merged(tbl.column("hash").to_numpy().view(np.uint64), tbl.column("n").to_numpy())
        p = key[0].as_py()
        save(f"{path}/words-{p}", ef_build(h, "hash") | ef_build(np.append(0, np.cumsum(n)), "count"))
        return pa.table({"part": pa.array([p], pa.int64()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    built = partial.mapInArrow(with_part, "part long, hash long, n long").groupBy("part").applyInArrow(build_words, "part long, words long, tokens long").collect()  # a row a part
    sizes = dict((r["part"], r["words"]) for r in built)
    n = sum(r["tokens"] for r in built)
    shards = max(1, -(-n // SHARD_TOKENS))
    per = VOLUME if isinstance(resolve(path)[0], fs.LocalFileSystem) else 1
    apart = f"{path}-shards" if per > 1 else path
    model: Model = (path, tuple(sizes.get(p, 0) for p in range(parts)), n, shards, HOT, per)

    def count_triples(batches):
        t, held, waiting = trie(*model), [], 0
        for text in training(batches):
            local, words, size = tokens_of(text)
            held.append((*t.words(hashes(words)), local, size))
            waiting += len(local)
            if waiting >= TRIPLES_AT_ONCE:
                yield triple_rows(t, held)
                held, waiting = [], 0
        if held:
            yield triple_rows(t, held)
        del held
        trim()

    def build_pairs(key, tbl):
        columns = [[v.as_buffer() for v in tbl.column(k)] for k in ("keys", "next", "counts")]
        key_, x, m = (np.concatenate(z) for z in ([np.cumsum(join_bytes(v, "<u8")) for v in columns[0]], [join_bytes(v, "<u4") for v in columns[1]], [join_bytes(v, "<u4").astype(np.int64) for v in columns[2]]))
        s = key[0].as_py()
        t = trie(*model)
        arrays = shard_arrays(key_, x, m, t.counts, t.bits)
        save(f"{apart}/pairs-{s}", arrays)
        pairs = len(arrays["code"])
        del columns, key_, x, m, arrays
        trim()  # as the next shard, or a task of the next stage, begins beside another worker's peak
        return pa.table({"shard": pa.array([s], pa.int64()), "pairs": pa.array([pairs], pa.int64())})

    dealt = docs.mapInArrow(count_triples, "shard long, keys binary, next binary, counts binary").repartition(shuffle_partitions(docs.sparkSession, shards, 1), "shard")
    made = dealt.groupBy("shard").applyInArrow(build_pairs, "shard long, pairs long").collect()  # a row a shard
    none = np.zeros(0, np.uint64)
    for s in set(range(shards)) - {r["shard"] for r in made}:
        save(f"{apart}/pairs-{s}", shard_arrays(none, none.astype(np.uint32), none.astype(np.int64), lambda c: c, np.uint64(1)))

    def join(batches):
        for b in batches:
            for v in b.column("id").to_pylist():
                save(f"{path}/pairs-{v}", ef_join([load(f"{apart}/pairs-{s}") for s in range(v * per, min(shards, v * per + per))]))
            trim()
            yield b

    if per > 1:
        files = -(-shards // per)
        docs.sparkSession.range(0, files, 1, files).mapInArrow(join, "id long").count()
        discard(docs.sparkSession, apart)
    return model


def contexts(x: np.ndarray, size: np.ndarray, end) -> np.ndarray:
    """What stands before every token; a text's first token follows an end."""
    before = np.append(end, x[:-1]) if len(x) else x
    before[np.cumsum(size) - size] = end
    return before


def probabilities(t: Trie, flat: np.ndarray, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, base probability and the model's probability of every token."""
    ids, count = t.words(hashes(words))
    p1 = (count + ADD) / (t.n + ADD * (t.v + 1))
    # Known words are numbered by id, so that the distinct pairs come sorted by their context.
    order = np.argsort(ids, kind="stable")[np.count_nonzero(ids < 0) :]
    nth = np.full(len(words), -1, np.int64)
    nth[order] = np.arange(len(order))
    word = nth[flat]
    before = contexts(word, size, nth[-1])
    back, *stand = t.contexts(ids[order], count[order])
    p = np.append(back, 1.0)[before] * p1[flat]
    known = np.flatnonzero((word >= 0) & (before >= 0))
    pair, where = np.unique(before[known] * len(order) + word[known], return_inverse=True)
    k, w = np.divmod(pair, max(1, len(order)))
    q, left, shard, place = t.pairs(k, ids[order[w]], ids[order], count[order], *stand)
    p[known] += q[where]
    # The pair that ends right before a token is its context of order 3, unless the token is its text's first.
    of = np.full(len(flat), -1, np.int64)
    of[known] = where
    of = np.append(-1, of[:-1]) if len(of) else of
    of[np.cumsum(size) - size] = -1
    third = np.flatnonzero(of >= 0)
    third = third[place[of[third]] >= 0]
    p[third] *= left[of[third]]
    third = third[word[third] >= 0]
    if len(third):
        want, back_to = np.unique(of[third] * len(order) + word[third], return_inverse=True)
        k, w = np.divmod(want, len(order))
        p[third] += t.triples(shard[k], place[k], ids[order[w]])[back_to]
    return count[flat], p1[flat], p


def score_tokens(t: Trie, flat: np.ndarray, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and score of every text."""
    count, p1, p = probabilities(t, flat, words, size)
    at = np.cumsum(size) - size
    add = lambda x: np.add.reduceat(x, at)
    return size, add((count > 0).astype(np.int64)), add(np.log10(p1)), add(np.log10(p))


def lm_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""

    def run(batches):
        t = trie(*model)
        for b in slices(batches, "text", ROWS_AT_ONCE, BYTES_AT_ONCE):
            n, known, base, score = score_tokens(t, *tokens_of(b.column("text")))
            held = pa.array([not fold(d) for d in b.column("doc_id").to_pylist()], pa.bool_())
            total = pa.array(np.full(b.num_rows, t.n, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), held, pa.array(n), pa.array(known), total, pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            release()
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, train(docs))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES: dict[str, str] = {}
