import random
import zlib
from collections import defaultdict

from tieout.llm import shard_packing as s


def plain_best_fit(sizes, capacity):
    room, out = [], []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            i = min(fits)[1]
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= size
        out.append(i)
    return out


def test_tree_gives_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randint(10, 200)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 200))), reverse=True)
        assert s.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_shards_are_near_equal():
    rng = random.Random(2)
    sizes = sorted((int(rng.paretovariate(1.2) * 100) for _ in range(5000)), reverse=True)
    bins = s.pack_shards(sizes, 8)
    total = [sum(x for x, b in zip(sizes, bins) if b == k) for k in range(8)]
    own = max(sizes)
    assert max(total) <= max(own, sum(total) / 8 * 1.02)
    assert s.pack_shards([100, 1, 1, 1, 1], 3)[0] not in s.pack_shards([100, 1, 1, 1, 1], 3)[1:]
    assert s.pack_shards([3], 8) == [0] and s.pack_shards([], 8) == []


def check(rows, got, shards):
    by_text, by_shard = defaultdict(set), defaultdict(list)
    texts = {(d, zlib.crc32((t or "").encode())): t for d, t in rows}
    for r in got:
        by_text[texts[r.doc_id, r.text_crc32] or ""].add(r.shard)
        by_shard[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id, r.text_crc32] or "").encode()) + 1 and 0 <= r.shard < shards
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())


def test_tables(docs, monkeypatch):
    monkeypatch.setattr(s, "CELL_ITEMS", 40)
    rng = random.Random(3)
    rows = [(i, f"text {i % 200} " * rng.randint(1, 30)) for i in range(600)] + [(1000 + i, "copy " * 10) for i in range(150)] + [(None, None), (5000, ""), (5000, ""), (6000, "é" * 70000)]
    got = s.shard(docs(*rows), 4).collect()
    assert len(got) == len(rows)
    check(rows, got, 4)
    kept = s.shard(docs(*rows), 4, keep=True)
    assert kept.columns == [c for c in docs().columns if c not in ("shard", "slot")] + ["shard", "slot"] and kept.count() == len(rows)
    assert s.shard(docs(), 4).count() == 0


def test_packets_of_packets(table):
    groups = table("item string, bytes long", [(f"i{k}", 10 + k % 7) for k in range(3000)])
    got = s.assign_groups(groups.sparkSession, groups, 4, units=512, most_items=700).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += 10 + int(r.item[1:]) % 7
    assert len({r.item for r in got}) == len(got) == 3000 and max(size.values()) < 1.05 * min(size.values())
