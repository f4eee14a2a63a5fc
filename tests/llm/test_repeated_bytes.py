import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tieout.llm import repeated_bytes as t

WIDTH = 40


def brute(texts, width=WIDTH):
    places = defaultdict(list)
    coded = [(x or "").encode() for x in texts]
    for k, c in enumerate(coded):
        for i in range(len(c) - width + 1):
            places[c[i : i + width]].append((k, i))
    gone = [np.zeros(len(c), bool) for c in coded]
    for group in places.values():
        for k, i in group if len(group) > 1 else []:
            gone[k][i : i + width] = True
    out = []
    for c, g in zip(coded, gone):
        kept = bytes(x for x, d in zip(c, g) if not d)
        spans = sum(bool(g[i]) and (i == 0 or not g[i - 1]) for i in range(len(g)))
        out.append((len(c), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed=4):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choices("abcdefgé \n", k=n))
    passages = [new(rng.randint(30, 160)) for _ in range(6)]
    out = []
    for _ in range(90):
        parts = [new(rng.randint(0, 90)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(0, 5))]
        out.append("".join(parts))
    out += [None, "", out[3], out[3], "a" * 500, "ab" * 300, "x" + passages[0][5:80] + "y" + passages[0][5:80], "\0" * 90]
    long = new(400)
    return out + [long[:i] + "#" + long[i:] for i in range(20, 400, 40)]  # near copies, one edit each


@pytest.mark.parametrize("shard_bytes,split", [(4_000_000, 2_000), (1_500, 2_000), (4_000_000, 2), (2_000, 0)])
def test_equals_brute_force(docs, shard_bytes, split):
    data = texts()
    got = t.remove_repeats(docs(*enumerate(data)), WIDTH, shard_bytes, split)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute(data)
    assert [tuple(r)[1:] for r in sorted(got.collect())] == want and sum(w[1] > 0 for w in want) > 50


def test_full_width_nulls_and_long_text(docs):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    data = [long, "q" + long[1_000_000:1_000_500] + "r", long[5:150], None, "", "z" * 199, "z" * 200, "y" * 201]
    rows = [(None if i == 3 else i, x) for i, x in enumerate(data)]
    got = {r.n_bytes: (r.n_removed, r.n_spans) for r in t.remove_repeats(docs(*rows)).collect()}
    assert got == {3_000_000: (500, 1), 502: (500, 1), 145: (0, 0), 0: (0, 0), 199: (0, 0), 200: (0, 0), 201: (201, 1)}


def test_kept_bytes_and_empty_table(docs):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    got = sorted(t.remove_repeats(docs((1, "1" + text + "2"), (2, text), (2, "é")), texts=True).collect())
    assert [bytes(r.kept) for r in got] == [b"12", b"", "é".encode()] or [bytes(r.kept) for r in got] == [b"12", "é".encode(), b""]
    assert t.remove_repeats(docs()).count() == 0


def test_stretches_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(t, "STRETCH", 700)
    rng = random.Random(5)
    data = ["".join(rng.choices("abc", k=k)) for k in (5000, 0, 39, 40, 1400, 741)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 6), pa.array(range(6)), pa.array(data)], names=["file", "row", "text"])
    seen = []
    for part in t.found_pieces(WIDTH)(iter([batch])):
        for row, at in zip(part["row"].to_pylist(), part["at"].to_pylist()):
            assert 0 < (at & 0xFF) <= WIDTH - t.GRAM + 1
            seen += [(row, (at >> 16) + k) for k in range(at & 0xFF)]
    assert sorted(seen) == [(k, i) for k, x in enumerate(data) for i in range(len(x) - WIDTH + 1)]
