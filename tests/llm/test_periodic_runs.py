import hashlib
import random
import zlib

import numpy as np
import pytest

from tieout.llm import periodic_runs as t


def brute(word, least=24, exponent=3):
    """Every stretch whose words q apart are identical, for every q, without those of a smaller period."""
    n, found = len(word), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(word[k] == word[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample(rng):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.4:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        else:
            unit = [rng.choice("ab" if kind < 0.7 else "abcdef") for _ in range(rng.randint(1, 12))]
            unit = unit * rng.randint(1, 9)
            out += unit[: rng.randint(1, len(unit))]
    return out


def test_automaton_finds_every_run():
    rng = random.Random(2)
    for _ in range(400):
        word = [ord(c) for c in sample(rng)]
        assert t.runs_of(word, 4, 3) == brute(word, 4, 3)


def test_filter_loses_no_run():
    rng = random.Random(3)
    seen = 0
    for _ in range(400):
        words = sample(rng)
        assert t.periodic_runs(words) == (want := brute(words))
        seen += bool(want)
    assert seen > 100


def test_stretches_leave_far_copies_out():
    line = [f"w{i}" for i in range(40)]
    words = line + [f"x{i}" for i in range(200)] + line + ["a", "b"] * 20
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert t.repeated_stretches(np.array([numbers[w] for w in words])) == [(280, 320)]


@pytest.mark.parametrize("words", [[], ["a"] * 23, [f"w{i}" for i in range(500)]])
def test_no_runs(words):
    assert t.periodic_runs(words) == []


def test_long_text_and_ties():
    words = (["a", "b"] * 12 + ["-"]) * 2 + [f"w{i % 7}" for i in range(60_000)]
    runs = t.periodic_runs(words)
    assert runs == [(0, 24, 2), (25, 24, 2), (50, 60_000, 7)] and t.highest(runs) == (50, 60_000, 7) and t.highest(runs[:2]) == (0, 24, 2)
    assert len(t.collapsed(words, runs)) == 2 + 2 + 1 + 1 + 7


def test_table(docs):
    texts = ["x " * 30, None, "", "one two\tthree\nfour ", "x " * 30, " ".join(f"w{i}" for i in range(90))]
    got = t.find_runs(docs(*[(i if i else None, x) for i, x in enumerate(texts)])).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [tuple(r) for r in got][0] == (None, 1, 0, 30, 1, 30000, sha("0,30,1\n"), sha("x"))
    assert tuple(got[1]) == (1, 0, None, None, None, None, sha(""), sha("")) and tuple(got[2])[1:] == tuple(got[1])[1:]
    assert got[3].collapsed_sha256 == sha("one two three four") and tuple(got[4])[1:] == tuple(got[0])[1:]
    assert t.find_runs(docs()).count() == 0


def test_planted_tails_equal_brute_force(docs):
    texts = [(i, " ".join(f"w{i}-{k}" for k in range(60 + i))) for i in range(40)]
    got = {r.doc_id: r for r in t.find_runs(docs(*texts), t.repeating).collect()}
    planted = 0
    for i, text in texts:
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            p = 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < g % n else words[g % n + (k - g % n) % p] for k, w in enumerate(words)]
        runs = brute(words)
        planted += bool(runs)
        assert got[i].n_runs == len(runs) and got[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
        assert got[i].collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert planted
