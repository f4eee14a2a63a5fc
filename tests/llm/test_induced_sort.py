import random

import numpy as np
import pytest

from tieout.llm import induced_sort as t


def strings(rng, alphabet="abc"):
    unit = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(6)]
    return ["".join(rng.choices(unit, k=rng.randint(0, 9))).encode() for _ in range(rng.randint(1, 9))]


@pytest.mark.parametrize("width", [1, 3, 8, 11])
@pytest.mark.parametrize("held", [0, 64_000_000])
def test_repeats_equal_brute_force(width, held, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 7)
    rng = random.Random(width)
    for n in range(150):
        texts = strings(rng, "ab" if n % 2 else "abcdé\0")
        places = {}
        for k, s in enumerate(texts):
            for i in range(len(s) - width + 1):
                places.setdefault(s[i : i + width], []).append((k, i))
        want = {p for group in places.values() if len(group) > 1 for p in group}
        got = {(k, int(i)) for k, flags in enumerate(t.repeated_starts(texts, width, held)) for i in np.flatnonzero(flags)}
        assert got == want


def test_common_prefixes_are_exact_below_the_depth():
    rng = random.Random(1)
    for _ in range(60):
        text = np.frombuffer(b"".join(strings(rng)) + b"\0", np.uint8)
        if len(text) < 2:
            continue
        raw, depth = text.tobytes(), 40
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        best = {i: 0 for i in order}
        for i, j in zip(order, order[1:]):
            n = 0
            while i + n < len(raw) and j + n < len(raw) and raw[i + n] == raw[j + n]:
                n += 1
            for k in (i, j):
                best[k] = max(best[k], min(n, depth))
        got = dict.fromkeys(order, 0)
        for suffix, common in t.neighbours(text, depth):
            for i, n in zip(suffix.tolist(), common.tolist()):
                got[i] = max(got[i], n)
        assert got == best


def test_runs_of_one_byte_and_empty_strings():
    assert [x.sum() for x in t.repeated_starts([b"a" * 5000, b"", b"b" * 300], 200)] == [4801, 0, 101]
    assert [len(x) for x in t.repeated_starts([b"", b"a"], 200)] == [0, 0]
