import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tieout.llm import pair_hash  # noqa: E402
from tieout.llm import token_alignment as t  # noqa: E402

PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", " ", "the", "\n", "é", "<s>", "</s>", "<|endoftext|>", "1", "  ", "x", "🙂", "\t", "\0", "tion", "ß", "   ", "<0x0A>", "'s", "don't", "\u00a0", " running ", "\x1c", "漢字"]


def brute(texts):
    """The contract by the two libraries alone: whole texts, every pair of tokens compared."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    whole = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    size_a = {i: len(bytes(back[c] for c in w)) for w, i in whole.items()}
    spell_a = {i: bytes(back[c] for c in w) for w, i in whole.items()}
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    aligned = []
    for text in texts:
        want = (" " + (text or "")).encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(spell_a[i] for i in x) != want or b"".join(map(spell_b, y)) != want:
            aligned.append(None)
            continue
        spans_a, spans_b, at = [], [], 0
        for i in x:
            spans_a.append((at, at := at + size_a[i], i))
        at = 0
        for i in y:
            spans_b.append((at, at := at + len(spell_b(i)), i))
        links = [(p[2], q[2]) for p in spans_a for q in spans_b if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in spans_a} & {q[1] for q in spans_b})
        groups = [",".join(str(p[2]) for p in spans_a if lo < p[1] <= hi) + "|" + ",".join(str(q[2]) for q in spans_b if lo < q[1] <= hi) for lo, hi in zip([0, *cuts], cuts)]
        aligned.append((x, y, links, groups))
    held = Counter(pair for d in aligned if d for pair in set(d[2]))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [
        (len(d[0]), len(d[1]), len(d[3]), len(d[2]), sum(held[p] == best[p[0]] for p in d[2]), sum(held[p] for p in d[2]), hashlib.sha256(";".join(d[3]).encode()).hexdigest())
        if d
        else (0, 0, 0, 0, 0, 0, "")
        for d in aligned
    ]


def texts():
    rng = random.Random(11)
    out = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(250)]
    return out + ["", None, " ", "  x", "x  ", "a▁b", "plain text", "plain text", "x" * 300, "<|endoftext|> tail", "漢字かな" * 40]


@pytest.mark.parametrize("block_keys", [2_000_000, 150])
def test_equals_brute_force(docs, block_keys):
    data = texts()
    got = t.align(docs(*enumerate(data)), *PATHS, block_keys=block_keys)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[1:] for r in sorted(got.collect())] == brute(data)


def test_nulls_repeats_and_empty_table(docs):
    rows = [(None, "same words"), (1, "same words"), (1, "same words"), (2, None)]
    got = [tuple(r) for r in t.align(docs(*rows), *PATHS).collect()]
    assert sum(r[1] > 0 for r in got) == 3 and len(got) == 4 and {r[6] for r in got if r[1]} == {3 * r[4] for r in got if r[1]}
    assert t.align(docs(), *PATHS).count() == 0


def test_word_table_is_emptied(docs):
    vocabularies = open(PATHS[0], "rb").read(), PATHS[1], open(PATHS[2], "rb").read()
    small, large = (t.WordTable(t.Tokenizers(*vocabularies), held=n) for n in (40, 100_000))
    data = [x for x in texts() if x] + ["word " * 30_000]
    for n in range(0, len(data), 7):
        one, two = t.Slice(small, data[n : n + 7]), t.Slice(large, data[n : n + 7])
        for k in range(4):
            assert (one.sums(small.arrays()[0][:, k]) == two.sums(large.arrays()[0][:, k])).all()
        assert [[small.groups[i] for i in x] for x in one.ids] == [[large.groups[i] for i in x] for x in two.ids]


def test_hash_is_minimal_perfect_and_verified():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**47, 5000))
    owner = pair_hash.buckets_of(keys, 3)
    levels = [(b, n, w.tobytes(), k.tobytes()) for b in range(3) for n, (w, k) in enumerate(pair_hash.cascade(keys[owner == b]), 1)]
    hashed = pair_hash.PairHash(3, levels)
    assert sorted(hashed.index(keys)) == list(range(len(keys))) and (hashed.keys[hashed.index(keys)] == keys).all()
    assert (hashed.index(np.setdiff1d(np.arange(10_000), keys)) == -1).all()
    assert (pair_hash.PairHash(1, []).index(keys) == -1).all()


def test_counts_are_added_in_a_tree(spark):
    rows = [(k, 1) for k in range(200) for _ in range(k + 1)]
    partial = spark.createDataFrame(rows, "key long, n long").repartition(30)
    levels, buckets, _ = pair_hash.built(partial.select("key").distinct(), 200, 1000)
    hashed = pair_hash.loaded(levels, buckets, 0, buckets)
    counts = pair_hash.summed_counts(partial, hashed)
    assert (counts == hashed.keys + 1).all()
