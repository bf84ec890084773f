import random

import numpy as np
import pytest

from filmroll.llm import suffixes


def common(a, b, depth):
    n = 0
    while n < depth and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def text(rnd, alphabet, parts, longest, unit):
    out = b""
    for _ in range(parts):
        piece = bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, unit)))
        out += (piece * rnd.randint(1, longest))[:rnd.randint(1, longest)] + b"\0"
    return out


@pytest.mark.parametrize("memory", [1 << 27, 2000])
@pytest.mark.parametrize("depth", [3, 12, 100])
def test_order_and_prefixes(tmp_path, memory, depth, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 64 if memory < 10_000 else 1 << 19)
    rnd = random.Random(depth)
    for trial in range(25):
        t = text(rnd, rnd.choice([b"a", b"ab", b"abc", bytes(range(1, 256))]), rnd.randint(1, 6), rnd.choice([1, 5, 60, 300]), rnd.choice([1, 3, 40]))
        folder = tmp_path / str(trial)
        folder.mkdir()
        found = list(suffixes.Sorter(np.frombuffer(t, np.uint8), depth, folder, memory).sorted())
        rows = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        assert sorted(rows[:, 0].tolist()) == list(range(len(t) - 1))
        keys = [t[p:p + depth] for p in rows[:, 0]]
        assert keys == sorted(keys)
        for i in range(1, len(rows)):
            # the end of the text is smaller than any byte, and two ends are never alike beyond it
            assert rows[i, 1] == common(t[rows[i - 1, 0]:], t[rows[i, 0]:], depth), (t, i)
