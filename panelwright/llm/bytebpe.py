"""A byte-level BPE vocabulary: token bytes, merge ranks, exact merging and pair compatibility."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import public_tokenizers

BYTE_BPE = "byte_bpe_50k.json"
#: Entries of a worker's memo before it is emptied; a bound on memory, not on results.
MEMO = 800_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes[i] = s.encode() if s in self.special else bytes(letters[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        plain = [i for s, i in vocab.items() if s not in self.special]
        self.id_of = {self.bytes[i]: i for i in plain}
        self.base = [self.id_of[bytes([b])] for b in range(256)]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.compatible_memo: dict[int, bool] = {}
        #: Trie of the vocabulary: child[node] maps a byte to a node, token[node] is its id or -1.
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in self.id_of.items():
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first: what the library's model does."""
        ids = [self.base[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merge.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := get(new << 20 | ids[k]):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            p = prv[i]
            if p >= 0 and (m := get(ids[p] << 20 | new)):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return [i for i in ids if i >= 0]

    def compatible(self, a: int, b: int) -> bool:
        """True if merging the bytes of token a followed by token b gives these two tokens again."""
        key = a << 20 | b
        known = self.compatible_memo.get(key)
        if known is None:
            if len(self.compatible_memo) > 2 * MEMO:
                self.compatible_memo.clear()
            known = self.compatible_memo[key] = self.exact(self.bytes[a] + self.bytes[b]) == [a, b]
        return known


def tokenizer_path(path: str | None = None) -> str:
    return path or public_tokenizers.path(BYTE_BPE)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """Ordinary pieces of a text, with the ids of the special strings between them."""
    out: list[str | int] = [text]
    for s, i in special.items():
        if s in text:
            out = [y for x in out for y in ([x] if isinstance(x, int) else [z for p in x.split(s) for z in (i, p)][1:])]
    return [x for x in out if x != ""]
