import random
import zlib

import numpy as np

from tieout.llm import byte_cnn as b

WORDS = "the river of stone and light over seven marble hills in morning rain with quiet birds".split()


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 400))
        bad = i % 4 == 0
        out.append((" ".join(w + "%%%" for w in words) if bad else " ".join(words), 0 if bad else 1))
    return out


def test_gradient_is_the_slope():
    net, texts, wanted, weight = b.start(3), [t.encode() for t, _ in sample(6, 1)], np.array([0, 1, 1, 0, 1, 1], np.float32), np.ones(6, np.float32)
    _, gradient = b._gradient(net, texts, wanted, weight)
    for k in range(len(net)):
        at, step, losses = np.unravel_index(np.abs(gradient[k]).argmax(), gradient[k].shape), 1e-2, []
        for sign in (1, -1):
            moved = [x.copy() for x in net]
            moved[k][at] += sign * step
            losses.append(b._gradient(b.Network(*moved), texts, wanted, weight)[0])
        assert abs((losses[0] - losses[1]) / (2 * step) - gradient[k][at]) < 0.05 * abs(gradient[k][at]) + 1e-3


def test_peaks_equal_a_plain_convolution():
    net, text = b.start(5), b"some bytes of text " * 60
    data, halves = b.layout([text])
    plain = np.zeros((halves[0], b.FILTERS), np.float32)
    for h in range(halves[0]):
        for at in range(h * b.HALF, (h + 1) * b.HALF, b.STRIDE):
            window = net.vectors[data[at : at + b.WIDTH]].reshape(-1)
            plain[h] = np.maximum(plain[h], window @ net.filters + net.bias)
    assert np.allclose(b.half_peaks(net, data)[: halves[0]], plain, atol=1e-4)


def test_scores_do_not_depend_on_the_batch_and_read_whole_texts():
    net = b.train([t.encode() for t, _ in sample(300, 2)], [q for _, q in sample(300, 2)], epochs=4)
    texts = [t.encode() for t, _ in sample(50, 9)]
    together = b.probabilities(net, texts)
    assert np.allclose(together, [b.probabilities(net, [t])[0] for t in texts], atol=1e-5)
    good = b.probabilities(net, texts)[[i for i in range(50) if i % 4]]
    bad = b.probabilities(net, texts)[::4]
    assert good.min() > bad.max()
    tail = (" ".join(WORDS) * 300).encode()
    assert b.probabilities(net, [tail])[0] != b.probabilities(net, [tail + b"%%% &&& " * 200])[0]


def test_tables(docs, table):
    rows = [(i, t) for i, (t, _) in enumerate(sample(240, 4))]
    labels = table("doc_id long, quality int, toxic int", [(i, q, 0) for i, (_, q) in enumerate(sample(240, 4))] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)])
    frame = docs(*rows, (None, None), (500, ""), (0, rows[0][1]))
    net = b.fit(frame, labels)
    got = b.score(frame, net).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id < 240]
    assert min(s for s, good in held if good) > max(s for s, good in held if not good)
    kept = frame.filter(b.text_scores(frame.text, net) >= 0.3)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in got)
    assert b.score(docs(), b.fit(docs(), labels)).count() == 0
