import hashlib
import zlib

import numpy as np
import pytest

from tieout.llm import telephony as t


def slow_adpcm(block):
    """One sample after the other."""
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(t.INDEX_MOVES[code])))
            out.append(value)
    return out


def test_block_decoding_equals_sample_by_sample():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 68), dtype=np.uint8)
    blocks[:, 2] %= 89
    assert t.decode_adpcm(blocks).tolist() == [slow_adpcm(bytes(b)) for b in blocks]


def test_companding_tables():
    mu, a = t.mulaw_table().astype(int), t.alaw_table().astype(int)
    # known points of both laws
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    for table in (mu, a):
        assert (np.sort(table[:128]) == -np.sort(-table[:128])[::-1]).all() and sorted(table) == sorted(-table)


@pytest.mark.parametrize("codec", t.CODECS)
@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 5000])
def test_round_trip(codec, text):
    payload = t.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    ((found, rate, back, pcm),) = t.decode_all([t.encode_media(payload, codec)])
    assert (found, rate, back) == (codec, 8000, payload)
    assert len(pcm) == (len(payload) if codec != t.ADPCM else len(payload) // 64 * 129)


def test_resampling_keeps_a_tone():
    time = np.arange(4000) / 8000
    tone = np.rint(10000 * np.sin(2 * np.pi * 440 * time)).astype(np.int16)
    for target in (16000, 11025, 4000):
        out = t.resample(tone, *t.phases(8000, target)).astype(float)
        want = 10000 * np.sin(2 * np.pi * 440 * np.arange(len(out)) / target)
        assert abs(len(out) - 4000 * target / 8000) <= 1 and np.abs(out - want)[50:-50].max() < 300


def test_table(docs):
    rows = docs((1, "hello"), (2, None), (None, ""), (3, "hello"), (1, "hello"), (4, "long " * 30000))
    got = {(r.doc_id, r.n_bytes): r for r in t.telephony(rows).collect()}
    assert t.telephony(rows).count() == 6 and set(got) == {(1, 5), (2, 0), (None, 0), (3, 5), (4, 150000)}
    assert got[1, 5].media == got[3, 5].media and got[2, 0].payload == bytes(64)
    assert hashlib.sha256(got[4, 150000].payload).hexdigest() == hashlib.sha256(t.padded("long " * 30000)).hexdigest()
    assert got[1, 5].codec == t.CODECS[zlib.crc32(t.padded("hello")) % 3] and len(got[1, 5].pcm) in (256, 516)
    assert t.telephony(docs()).count() == 0
