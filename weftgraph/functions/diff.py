"""Line differences of two texts by longest common subsequences, in rows of bits.

A row of the table holds, for one suffix of the first text, where the common
length grows along the second one: one bit a line. A row comes from the one before
by a sum and a few logical operations on whole integers, so a table of 100,000
times 100,000 lines takes seconds and one row of memory. ``operations`` keeps every
s-th row (s about the root of the number) and makes the rows between again when
it comes to them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt


def _masks(lines: Sequence[str]) -> dict[str, int]:
    """For each line the places where it stands, as bits."""
    places: dict[str, bytearray] = {}
    size = len(lines) // 8 + 1
    for at, line in enumerate(lines):
        places.setdefault(line, bytearray(size))[at >> 3] |= 1 << (at & 7)
    return {line: int.from_bytes(bits, "little") for line, bits in places.items()}


def _step(row: int, mask: int, full: int) -> int:
    met = row & mask
    return ((row + met) | (row - met)) & full


def common(x: Sequence[str], y: Sequence[str]) -> int:
    """Length of a longest common subsequence."""
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    end = 0
    while end < min(len(x), len(y)) - low and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[low : len(x) - end], y[low : len(y) - end]
    both = set(x) & set(y)
    x, y = [a for a in x if a in both], [b for b in y if b in both]  # other lines are common to nothing
    if not x or not y:
        return low + end
    masks, full = _masks(y), (1 << len(y)) - 1
    row = full
    for line in x:
        row = _step(row, masks[line], full)
    return low + end + len(y) - row.bit_count()


def operations(x: Sequence[str], y: Sequence[str]) -> Iterator[tuple[str, str]]:
    """(``context`` | ``add`` | ``remove``, line) that make y of x: equal lines are kept as they come, and where both an addition and a removal keep the longest common rest, the addition comes first."""
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        yield "context", x[start]
        start += 1
    x, y = x[start:], y[start:]
    n, m = len(x), len(y)
    masks, full = _masks(y[::-1]), (1 << m) - 1
    every = max(1, isqrt(n))
    kept = [full]  # rows of 0, every, 2 * every, ... lines from the end of x
    row = full
    for k in range(1, n + 1):
        row = _step(row, masks.get(x[n - k], 0), full)
        if k % every == 0:
            kept.append(row)
    block: list[int] = []
    block_from = None

    def rest(i: int) -> int:
        """The row of x[i:]."""
        nonlocal block, block_from
        k = n - i
        begin = k // every * every
        if begin != block_from:
            block, block_from = [kept[begin // every]], begin
            for step in range(begin + 1, min(begin + every, n + 1)):
                block.append(_step(block[-1], masks.get(x[n - step], 0), full))
        return block[k - begin]

    def length(bits: int, j: int) -> int:
        """Common length with y[j:] by a row."""
        width = m - j
        return width - (bits & ((1 << width) - 1)).bit_count()

    i = j = 0
    below = rest(1) if n else full
    own = rest(0) if n else full
    here, under = length(own, 0), length(below, 0) if n else 0  # of x[i:] and x[i + 1:] with y[j:]
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            yield "context", x[i]
            i, j = i + 1, j + 1
            if i < n or j < m:
                own, below = below, rest(i + 1) if i < n else full
                here, under = length(own, j), length(below, j) if i < n else 0
            continue
        grows = j < m and not own >> (m - j - 1) & 1
        if j < m and (i >= n or here - grows >= under):
            yield "add", y[j]
            here -= grows
            under -= j < m and i < n and not below >> (m - j - 1) & 1
            j += 1
        else:
            yield "remove", x[i]
            i += 1
            own, here = below, under
            below = rest(i + 1) if i < n else full
            under = length(below, j) if i < n else 0


def unified(current: str, staged: str, label: str) -> str:
    """The difference as text: every line with its sign, under the two names."""
    sign = {"add": "+", "remove": "-", "context": " "}
    return "\n".join([f"--- a/{label}", f"+++ b/{label}", *(sign[op] + line for op, line in operations(current.split("\n"), staged.split("\n")))])
