"""Tokens and boxes: every overlapping pair counts once, and the join does not trust sizes estimated before tiles are exploded."""

import random

from tieout.operators import ingest as I
from tieout.session import deal


def test_assignment_equals_all_pairs(rows, capsys):
    rnd = random.Random(5)
    span = lambda most: (lambda a: (a, a + rnd.randint(1, most)))(rnd.randint(-70, 300))
    tokens = [(n, *span(90), *span(30)) for n in range(60)]
    boxes = [(n // 6, n % 6, *span(200), *span(150)) for n in range(40)]
    t = rows("doc_id int, table_idx int, token_id int, x1 int, y1 int, x2 int, y2 int, text string", *[(1, 2, n, a, c, b, d, "t") for n, a, b, c, d in tokens])
    b = rows("doc_id int, table_idx int, row_idx int, col_idx int, x1 int, y1 int, x2 int, y2 int", *[(1, 2, r, k, a, c, e, d) for r, k, a, e, c, d in boxes])
    want = {}
    for n, a, e, c, d in tokens:
        best = None
        for r, k, p, q, u, v in boxes:
            w, h = min(e, q) - max(a, p), min(d, v) - max(c, u)
            if w <= 0 or h <= 0:
                continue
            own, area = w * h / ((e - a) * (d - c)), (e - a) * (d - c) + (q - p) * (v - u) - w * h
            inside = p <= (a + e) / 2 <= q and u <= (c + d) / 2 <= v
            best = max(filter(None, (best, (round(max(w * h / area, own * 0.8), 9), -r, -k, inside))))
        if best and best[3]:
            want[n] = (-best[1], -best[2])
    out = I.assign_tokens(t, b)
    assert {r.token_id: (r.row_idx, r.col_idx) for r in out.collect()} == want
    out.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_small_pages_equal_tiles_and_are_moved_once(rows):
    rnd = random.Random(7)
    span = lambda most: (lambda a: (a, a + rnd.randint(1, most)))(rnd.randint(-70, 300))
    box = "x1 int, y1 int, x2 int, y2 int"
    tokens = [(n % 3, n % 3, n, a, c, b, d, "t") for n in range(90) for (a, b), (c, d) in [(span(90), span(30))]]
    boxes = [(n % 4, n % 4, n // 6, n % 6, a, c, b, d) for n in range(80) for (a, b), (c, d) in [(span(200), span(150))]]
    t = rows(f"doc_id int, table_idx int, token_id int, {box}, text string", *tokens, (None, 1, 1, 0, 0, 5, 5, "t"))
    b = rows(f"doc_id int, table_idx int, row_idx int, col_idx int, {box}", *boxes)
    key = ["doc_id", "table_idx"]
    small = I.assign_tokens(deal(t, key, 1), deal(b, key, 1))
    texts = I.cell_texts(small)
    assert texts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # tokens and boxes, each once
    tiled = I.assign_tokens(t, b, small=False)
    assert sorted(map(str, small.collect())) == sorted(map(str, tiled.collect())) and tiled.count() > 10
    assert sorted(map(str, texts.collect())) == sorted(map(str, I.cell_texts(tiled).collect()))
