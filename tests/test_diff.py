"""Line differences against the plain table."""

from __future__ import annotations

import random
import time

import pytest

from weftgraph.functions import diff as D


def plain(x, y):
    n, m = len(x), len(y)
    dp = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            dp[i][j] = dp[i + 1][j + 1] + 1 if x[i] == y[j] else max(dp[i + 1][j], dp[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(("context", x[i]))
            i, j = i + 1, j + 1
        elif j < m and (i >= n or dp[i][j + 1] >= dp[i + 1][j]):
            out.append(("add", y[j]))
            j += 1
        else:
            out.append(("remove", x[i]))
            i += 1
    return dp[0][0], out


@pytest.mark.parametrize("letters", ["a", "ab", "abcde", "abcdefghijklmnopqrstuvwxyz"])
def test_equal_to_the_plain_table(letters):
    draw = random.Random(letters)
    for _ in range(300):
        x, y = ([draw.choice(letters) for _ in range(draw.randint(0, 14))] for _ in range(2))
        if draw.random() < 0.5:
            y = [a for a in x if draw.random() < 0.8] + [draw.choice(letters) for _ in range(draw.randint(0, 3))]
        length, ops = plain(x, y)
        assert D.common(x, y) == length
        assert list(D.operations(x, y)) == ops, (x, y)


def test_long_texts():
    draw = random.Random(1)
    x = [f"line {draw.randint(0, 30_000)}" for _ in range(100_000)]
    y = [a if draw.random() < 0.99 else "changed" for a in x if draw.random() < 0.99]
    began = time.time()
    length = D.common(x, y)
    assert time.time() - began < 20 and 0.97 * len(x) < length < 0.985 * len(x)
    small, other = x[:6_000], [a for a in y[:6_000]]
    ops = list(D.operations(small, other))
    assert [line for op, line in ops if op != "add"] == small and [line for op, line in ops if op != "remove"] == other
    assert sum(op == "context" for op, _ in ops) == D.common(small, other)


def test_unified():
    assert D.unified("a\nb\nc", "a\nx\nc", "p.md") == "--- a/p.md\n+++ b/p.md\n a\n+x\n-b\n c"
