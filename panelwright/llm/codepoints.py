"""Classes of code points as a tokenizer's own pre-tokenizer has them.

Unicode tables differ between libraries, so letters, numbers and white space are not taken from
Python's: every code point that any table here calls assigned is put through the pre-tokenizer in
a probe (``a?1a?!``), and where it cuts the probe tells the class. Driver and workers share the result.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

OTHER, LETTER, NUMBER, BLANK = range(4)
PROBES_AT_ONCE = 20_000


@lru_cache(maxsize=1)
def regex_classes() -> np.ndarray:
    """The same classes in the tables of the module ``regex``."""
    line = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(name, line):
            a, b = ord(line[m.start()]), ord(line[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


@lru_cache(maxsize=4)
def library_classes(path: str) -> np.ndarray:
    pre = Tokenizer.from_file(path).pre_tokenizer
    keeps_blanks = sum(b - a for _, (a, b) in pre.pre_tokenize_str("a\ta")) == 3
    known = regex_classes()
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    probe = [c for c in range(sys.maxunicode + 1) if known[c] != OTHER or unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    for at in range(0, len(probe), PROBES_AT_ONCE):
        part = probe[at : at + PROBES_AT_ONCE]
        begins = np.zeros(6 * len(part) + 1, bool)
        spans = np.array([s for _, s in pre.pre_tokenize_str("".join(f"a{chr(c)}1a{chr(c)}!" for c in part))])
        begins[spans[:, 0]] = True
        edges = np.bincount(spans[:, 0], minlength=len(begins) + 1) - np.bincount(spans[:, 1], minlength=len(begins) + 1)
        covered = np.cumsum(edges)[:-1] > 0
        k = 6 * np.arange(len(part))
        joined, with_digit, with_sign = (~begins[k + n] & covered[k + n] for n in (1, 2, 5))
        lone = BLANK if keeps_blanks else NUMBER  # numbers come one by one where white space is dropped
        kind = np.where(joined, LETTER, np.where(with_sign, OTHER, np.where(with_digit, NUMBER, np.where(covered[k + 1], lone, BLANK))))
        out[part] = kind
    out[ord(" ")] = BLANK  # the probe shows it joined to what follows
    return out


@lru_cache(maxsize=4)
def unlike(path: str) -> frozenset[str]:
    """Characters whose class the module ``regex`` has otherwise than the tokenizer."""
    return frozenset(map(chr, np.flatnonzero(library_classes(path) != regex_classes()).tolist()))
