import itertools
import random
import re

import numpy as np

from tieout.llm import skip_chain_crf as c

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The contract, pattern by pattern."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and c.luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "1", "22", "255", "256", ".", "@", "-", " ", "+", "(", "_", "%", "é", "4111111111111111", "+1 (234) 555-1234", "x.y@b.co", "b.co", "0", "\n"]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert c.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + " " * 100_000, "@" * 100_000):
        c.base_spans(text)
        c.graph([text], [[]])


def chain_graph(features, fixed, chain, skip):
    return c.Graph(np.array(features, float), np.array(fixed), np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2), [])


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(4)
    w = c.Weights(rng.normal(size=(c.FEATURES, c.LABELS)), rng.normal(size=(c.LABELS,) * 2), (lambda s: s + s.T)(rng.normal(size=(c.LABELS,) * 2)))
    g = chain_graph(rng.normal(size=(4, c.FEATURES)), [0, 0, 0, 2], [(0, 1), (1, 2)], [(0, 3)])
    unary, total = g.features @ w.unary, np.zeros((4, c.LABELS))
    for y in itertools.product(range(c.LABELS), repeat=4):
        if y[3] == 2:
            p = np.exp(unary[range(3), y[:3]].sum() + w.chain[y[0], y[1]] + w.chain[y[1], y[2]] + w.skip[y[0], 2])
            total[range(4), y] += p
    assert c.labels(g, w, rounds=30).tolist() == total.argmax(1).tolist()


TRAIN = [f"call +1 (487) 555-{n:04d} or mail a{n}@mail.example.com, {n} items, host 10.0.0.{n % 256}, card 4111111111111111 and +1 (487) 555-{n:04d} again a{n}@mail.example.com" for n in range(150)]


def trained():
    return c.train(c.graph(TRAIN, [c.base_spans(t) for t in TRAIN]))


def test_similar_tokens_get_the_same_label():
    w = trained()
    text = "call +1 (487) 555-7209 now; later 487-555-7209, and 12 items"
    base = c.base_spans(text)
    g = c.graph([text], [base])
    added = c.added_spans(g, c.labels(g, w), [base], [text])[0]
    assert [text[a:b] for a, b, _ in added] == ["487-555-7209"] and added[0][2] == 3
    alone = "later 487-555-7209x and 12 items with 7 parts"
    g = c.graph([alone], [[]])
    assert not c.added_spans(g, c.labels(g, w), [[]], [alone])[0]


def test_tables(docs):
    rows = docs((1, TRAIN[5]), (2, None), (None, ""), (1, TRAIN[5]), (3, "clean text of 12 words in 3 lines"), (4, "0 " * 100_000))
    w = trained()
    got = sorted(c.find_personal_data(rows, w).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == 6 and got[0] == got[1] and got[0].n_email == 2 and got[0].n_phone == 2 and got[0].n_card == 1 and got[0].n_ip == 1
    assert set(got[0].base.split(",")) <= set(got[0].spans.split(","))
    assert [(r.doc_id, r.spans) for r in got[2:]] == [(2, ""), (3, ""), (4, ""), (None, "")]
    assert c.find_personal_data(docs()).count() == 0
    assert c.find_personal_data(rows).count() == 6  # weights fitted on the rows themselves


def added(text, w):
    base = c.base_spans(text)
    g = c.graph([text], [base])
    return [(text[a:b], k) for a, b, k in c.added_spans(g, c.labels(g, w), [base], [text])[0]]


def test_labels_reach_every_occurrence_of_a_key():
    text = "call +1 (487) 555-7209 now" + "; later 487-555-7209 and more" * 40
    unary = np.zeros((c.FEATURES, c.LABELS))
    unary[0, 0] = 3.0  # by itself no token is anything
    w = c.Weights(unary, np.zeros((c.LABELS,) * 2), 5 * np.eye(c.LABELS))
    assert added(text, w) == [("487-555-7209", 3)] * 40 and not added(text.replace("+1", "1"), w)


def test_message_passing_goes_on_until_it_settles():
    n = 60
    w = c.Weights(np.zeros((c.FEATURES, c.LABELS)), 6 * np.eye(c.LABELS), np.zeros((c.LABELS,) * 2))
    g = chain_graph(np.zeros((n, c.FEATURES)), [2] + [0] * (n - 1), [(i, i + 1) for i in range(n - 1)], [(0, 1)])
    assert c.labels(g, w).tolist() == [2] * n


def test_keys_join_tokens_across_white_space():
    unary = np.zeros((c.FEATURES, c.LABELS))
    unary[0, 0] = 3.0
    w = c.Weights(unary, np.zeros((c.LABELS,) * 2), 5 * np.eye(c.LABELS))
    assert added("call +1 555 123 4567 now, or 555-123-4567, or 555 123 4567 555 123 4567 or 12 items", w) == [("555-123-4567", 3), ("555 123 4567", 3), ("555 123 4567", 3)]
    assert added("card 4111 1111 1111 1111 is 4111.1111.1111.1111 or 4111  1111  1111  1111 and 4111 pieces", w) == [("4111.1111.1111.1111", 2), ("4111  1111  1111  1111", 2)]
    assert added("later 555 123 4567 and 123 4567", w) == []


def test_runs_of_numbers_take_linear_time():
    text = "+1 555 123 4567 " + "0 " * 100_000
    c.graph([text], [c.base_spans(text)])
