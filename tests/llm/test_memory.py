"""What a task holds in memory, in bytes for each byte or key that it works on."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from verdikt.llm import lm_scoring, suffix_dedup


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_shard_takes_few_bytes_for_each_of_its_own():
    rng = np.random.default_rng(3)
    base = [rng.integers(97, 123, 900, np.uint8).tobytes() for _ in range(500)]
    texts = [x for b in base for x in (b, b[:500] + b"#" + b[500:])]
    shard, most = peak(lambda: suffix_dedup.Shard.of(texts, [len(t) - 399 for t in texts], [1] * len(texts), 400))
    assert most < 40 * len(shard.text)
    assert (shard.total >= 2).sum() == 500 * (101 + 1)


def test_suffix_array_by_small_parts():
    rng = random.Random(4)
    for text in (bytes(rng.choices(b"ab", k=3000)), b"ab" * 700 + b"a", b"x" * 500, b"abc", b""):
        for most in (1, 7, 1 << 19):
            sa, rank = suffix_dedup.suffix_array(text, most)
            assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
            assert rank.tolist() == np.argsort(sa).tolist()


def test_counting_holds_few_bytes_for_each_key_and_passes_them_on():
    rng = np.random.default_rng(6)
    blocks = [rng.integers(0, 1 << 40, 100_000).astype(np.uint64) for _ in range(40)]

    def count():
        t, got = lm_scoring.Tally(1_000_000), []
        for i, b in enumerate(blocks):
            t.add(b, i % 5 != 1)
            if t.full():
                got += [(len(k), int(n.sum())) for k, n in t.drain()]
        return got + [(len(k), int(n.sum())) for k, n in t.drain()]

    got, most = peak(count)
    assert sum(n for _, n in got) == 32 * 100_000 and sum(k for k, _ in got) > 3_900_000
    assert most < 80_000_000


def test_counts_are_of_training_and_keys_of_all(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 50)
    rng, t, want = np.random.default_rng(1), lm_scoring.Tally(), Counter()
    for i in range(60):
        keys = rng.integers(0, 300, 33).astype(np.uint64)
        t.add(keys, i % 3 != 1)
        for k in keys.tolist():
            want[k] += i % 3 != 1
    assert dict(x for k, n in t.drain() for x in zip(k.tolist(), n.tolist())) == want
    assert not list(t.drain())
