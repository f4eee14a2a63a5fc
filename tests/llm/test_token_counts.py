import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tieout.llm import token_counts as t  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def processor():
    with open(PATH, "rb") as f:
        return t.load(f.read())


def test_premise_and_proof(processor):
    assert t.splits_at_marks(processor)
    whole = t.whole_tokens(processor)
    assert len(whole) > 10000 and all(len(i) == 1 for i in processor.encode(sorted(whole)))


def test_counts_equal_the_library(processor):
    rng = random.Random(5)
    parts = ["a", " ", "the", "▁", "\n", "é", "<s>", "</s>", "1", "  ", "x", "🙂", "\t", "\0", "tion", "ß", "   ", "<0x0A>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + ["", None, " ", "word " * 20000, "x" * 30000]
    counter = t.TokenCounter(processor, t.whole_tokens(processor), held=500)  # emptied many times
    got = [n for a in range(0, len(texts), 100) for n, _ in counter.counts(texts[a : a + 100])]
    assert got == [len(processor.encode(x or "")) for x in texts]


def test_texts_without_spaces_are_not_kept(processor):
    rng = random.Random(6)
    texts = ["".join(rng.choices("漢字かな漢語abc", k=rng.randint(1, 400))) for _ in range(300)]
    counter = t.TokenCounter(processor, t.whole_tokens(processor))
    got = [n for a in range(0, 300, 50) for n, _ in counter.counts(texts[a : a + 50])]
    assert got == [len(processor.encode(x)) for x in texts] and max(map(len, counter.merged)) <= t.LONGEST
    assert len(counter.long) <= 50


def test_table(docs):
    rows = docs((1, "hello world"), (2, None), (None, ""), (1, "hello world"), (3, "a " * 5000))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in t.count_tokens(rows, PATH).collect())
    assert [g[:2] for g in got] == [(-1, 0), (1, 11), (1, 11), (2, 0), (3, 10000)] and got[-1][3] and not got[0][3] and got[0][2] == 0
    assert t.count_tokens(docs(), PATH).count() == 0
