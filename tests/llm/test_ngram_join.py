import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tieout.llm import ngram_join as n
from tieout.llm.shingles import Hasher


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[find(i)] = find(k)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_sets_equal_python_sets():
    texts = ["", None, "a", " \t\n", "A b", "a B c d", "a b c d e", "x\ny\x0bz a b c", "a a a a a a a a", "é ü É w w w", "one two three four five six " * 50]
    owner, value = Hasher().sets(texts)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
    again, more = Hasher().sets(texts[::-1])
    assert set(value.tolist()) == set(more.tolist())


def corpus(rng, families=12):
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=14))
    rows = []
    for _ in range(families):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 30, 60, 150]))
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy) + (" " + line if rng.random() < 0.4 else ""))
    rows += [line + " " + rng.choice(words) for _ in range(15)] + rows[:5] + ["", " ", "one"]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs, seed, monkeypatch):
    rng = random.Random(seed)
    rows = corpus(rng)
    if seed == 2:  # several column blocks, no frequent columns
        monkeypatch.setattr(n, "BLOCK_ENTRIES", 500)
        monkeypatch.setattr(n, "FREQUENT", 2.0)
    got = n.near_duplicates(docs(*rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_nulls_and_repeats(docs):
    text = "one two three four five six seven eight"
    rows = docs((5, text), (5, text), (3, text.upper()), (None, text), (7, None), (8, ""), (None, None))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in n.near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(5, 4, 3), (5, 4, 3), (3, 4, 3), (None, 4, 3), (7, 0, 7), (8, 0, 8), (None, 0, None)], key=repr)
    assert n.near_duplicates(docs()).count() == 0
    assert [r.component_id for r in n.near_duplicates(docs((1, "x " * 60000))).collect()] == [1]


def test_bound_is_the_similarity():
    for a in range(1, 40):
        for b in range(1, 40):
            for o in range(min(a, b) + 1):
                assert (o >= n.need(a + b)) == (100 * o >= 75 * (a + b - o))
