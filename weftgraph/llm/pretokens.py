"""Pre-tokens of many texts at once, and their ids through a cache of the library's answers.

The pattern is the public byte-level one: contractions, then runs of letters,
numbers or other signs with one space before them, then white space, of which
the last character stays for what follows. Its matches follow from character
classes alone, so they are found with array operations over all texts of a
batch; tests hold them against the pattern itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, SPACE, SIGN, END = 1, 2, 3, 4, 5
APOSTROPHE, BLANK = 0x27, 0x20
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; one more, behind the last, marks the end of a text."""
    table = np.full(0x110001, SIGN, dtype=np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for m in regex.finditer(f"{pattern}+", every):
            table[m.start() : m.end()] = kind
    table[0xD800:0xE000] = SIGN
    table[0x110000] = END
    return table


def split(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens in order, each text's followed by an empty one; and for each text the number of its pre-tokens with that one."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1) - 1
    code = np.full(int(lengths.sum()) + len(texts), 0x110000, dtype=np.uint32)
    inside = np.ones(len(code), dtype=bool)
    inside[ends] = False
    joined = "".join(texts)
    code[inside] = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    kind = classes()[code]
    first = np.ones(len(code), dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends] = True
    first[ends[:-1] + 1] = True
    # White space before a run that is not an end gives up its last character: to the run if it is a blank, else as a token of its own.
    runs = np.flatnonzero(first)
    follows = runs[1:][(kind[runs[1:]] != END) & (kind[runs[1:] - 1] == SPACE)]
    first[follows - 1] = True
    first[follows[code[follows - 1] == BLANK]] = False
    # An apostrophe that begins a token and stands alone takes a contraction's letters.
    for at in np.flatnonzero((code == APOSTROPHE) & first).tolist():
        if kind[at + 1] == LETTER:
            behind = "".join(map(chr, code[at + 1 : at + 3][kind[at + 1 : at + 3] != END]))
            for letters in CONTRACTIONS:
                if behind.startswith(letters):
                    first[at + 1] = False
                    if kind[at + 1 + len(letters)] == LETTER:
                        first[at + 1 + len(letters)] = True
                    break
    starts = np.flatnonzero(first)
    data = joined.encode()
    if len(data) == len(joined):
        width = inside.astype(np.int32)
    else:
        width = (1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)) * inside
    at_byte = np.zeros(len(code) + 1, dtype=np.int32)
    np.cumsum(width, out=at_byte[1:])
    offsets = np.append(at_byte[starts], at_byte[-1]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    per_text = np.diff(np.searchsorted(starts, ends), prepend=-1)
    return tokens, per_text


class Coder:
    """Ids of pre-tokens; ``encode_new`` gets the ones not met before and returns the ids of each. The cache is emptied at ``most`` entries."""

    def __init__(self, encode_new: Callable[[list[str]], list[Sequence[int]]], end: Sequence[int] = (), most: int = 1_000_000):
        self.encode_new, self.most, self.end = encode_new, most, np.asarray(end, dtype="<u4").tobytes()
        self.known: dict[str, bytes] = {"": self.end}

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many of them each text has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        tokens, per_text = split(texts)
        coded = tokens.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if len(self.known) + len(own) > self.most:
            self.known = {"": self.end}
        known = self.known
        new = [w for w in own if w not in known]
        for word, ids in zip(new, self.encode_new(new) if new else [], strict=True):
            known[word] = np.asarray(ids, dtype="<u4").tobytes()
        parts = [known[w] for w in own]
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        count = size[which]
        total = np.cumsum(count)
        out = flat[np.repeat(begin[which] - (total - count), count) + np.arange(total[-1])]
        last = np.cumsum(per_text) - 1
        return out, np.diff(total[last], prepend=0)
