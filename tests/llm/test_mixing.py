from collections import Counter, defaultdict

from tieout.llm.mixing import mix, schedule, smoothed_weights


def test_every_prefix_is_less_than_one_block_from_target(table):
    counts = table("source string, n long, weight long", [("a", 10, 700), ("b", 10, 200), ("c", 10, 99), ("d", 10, 1), ("e", 10, 0)])
    plan = schedule(counts, period=128).first()
    parts, period = list(plan.parts), plan.period
    assert period == 128 and sum(parts) == period and min(parts) >= 1
    done = Counter()
    for slot, pick in enumerate(plan.picks):
        assert pick.release <= slot < pick.deadline and pick.j == done[pick.i] and list(pick.done) == [done[i] for i in range(5)]
        done[pick.i] += 1
        for i, p in enumerate(parts):
            assert abs(done[i] - p * (slot + 1) / period) < 1
    assert [done[i] for i in range(5)] == parts


def test_mixing_places_every_row_once(docs, table):
    rows = docs(*[(i, f"t{i}") for i in range(300)], (7, "t7"), (None, None), source=lambda i: None if i is None else ("hot" if i % 3 else f"s{i % 4}"))
    weights = table("source string, weight long", [("hot", 10), ("s0", 30), ("s1", 30), ("s1", 1), ("gone", 5), (None, 2)])
    got = mix(rows.drop("block", "position", "slot"), weights, block_rows=2, period=64).collect()
    assert sorted(r.position for r in got) == list(range(302))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by[r.source].append(r.block)
    for blocks in by.values():
        assert blocks == [i // 2 for i in range(len(blocks))]
    order = [r.slot for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_prefix_keeps_clashing_columns(docs):
    got = mix(docs((1, "a"), (2, "b")), prefix="m_").collect()
    assert {r.position for r in got} == {"x"} and {r.m_position for r in got} == {0, 1}


def test_empty_table(docs):
    assert mix(docs(), prefix="m_").count() == 0
    assert smoothed_weights(docs()).count() == 0
