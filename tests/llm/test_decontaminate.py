import random

from tieout.llm import decontaminate as d

WORDS = "river stone lamp seven under marble green quickly window paper forest silver engine cloud butter".split()


def brute(item, text, k):
    """(least edits, first end) by the full table."""
    row = list(range(len(item) + 1))
    best = None
    for at, c in enumerate(text, 1):
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != x))
        if row[-1] <= k and (best is None or row[-1] < best[0]):
            best = (row[-1], at)
    return best


def edited(text, n, rng):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        text[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
    return "".join(text)


def test_matches_equal_brute_force():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 14)))) for i in range(12)]
    matcher = d.Matcher(items, rate=8)
    hits = 0
    for _ in range(150):
        text = " ".join(rng.choices(WORDS, k=20)) + " " + edited(rng.choice(items)[1], rng.randint(0, 8), rng) + " " + " ".join(rng.choices(WORDS, k=10))
        got = {item: (edits, end) for item, edits, _, end in matcher.find(text)}
        for item, raw in items:
            content = d.normal(raw)
            want = brute(content, d.normal(text), len(content) // 8)
            assert got.get(item) == want
            hits += want is not None
    assert hits > 100


def test_pieces_cover_the_item():
    for k in (0, 1, 5):
        assert "".join(p for _, p in d.pieces("abcdefghijkl", k)) == "abcdefghijkl" and len(d.pieces("abcdefghijkl", k)) == k + 1


def test_tables(docs, table):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today"
    bench = table("item_id long, text string", [(1, item), (2, None), (3, "..."), (None, item), (1, item)])
    rows = docs((1, "x " * 400 + item.upper().replace(" ", " - ") + " y"), (2, None), (3, ""), (4, "nothing of the kind"), (None, item.replace("quick", "quack")), (1, "x " * 400 + item.upper().replace(" ", " - ") + " y"))
    got = sorted((r.doc_id or -1, r.item_id or -1, r.edits) for r in d.find_contamination(rows, bench).collect())
    assert got == sorted([(a, b, e) for a, e in ((1, 0), (1, 0), (-1, 1)) for b in (1, 1, -1)])
    kept = d.decontaminate(rows, bench)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert d.find_contamination(docs(), bench).count() == 0
    assert d.find_contamination(rows, bench.limit(0)).count() == 0
    assert d.decontaminate(rows, bench.limit(0)).count() == 6


def test_blocks_of_items_change_nothing(docs, table):
    bench = table("item_id long, text string", [(i, f"{w} {v} {u} of the item") for i, (w, v, u) in enumerate(zip(WORDS, WORDS[3:], WORDS[5:]))])
    rows = docs((1, "river seven marble of the item and forest cloud butter of the item"))
    blocks = list(d.item_blocks(bench, block_chars=60))
    assert len(blocks) > 3
    together = {h[0] for h in d.Matcher([i for b in blocks for i in b]).find(rows.first().text)}
    assert {h[0] for b in blocks for h in d.Matcher(b).find(rows.first().text)} == together
