"""Strings of SPAN bytes by parts: what is compared, what a shard holds, and results at the edges of parts."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from voxloom.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def removed(texts):
    """doc_id, n_removed, n_spans and kept_sha256 by brute force."""
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for doc, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        kept = "".join(c for c, g in zip(t, gone) if not g)
        out.append((doc, int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_texts_that_share_few_bytes_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    phrases = [letters(rng, 60) for _ in range(40)]
    texts = [letters(rng, 300) + phrase + letters(rng, 300) for phrase in phrases for _ in range(3)]
    shared = Counter(letters for text in texts for letters in {text[i : i + suffix_dedup.K] for i in range(len(text) - suffix_dedup.K + 1)})
    assert max(shared.values()) == 3
    asked, resolve = [], suffix_dedup.resolve
    monkeypatch.setattr(suffix_dedup, "resolve", lambda items, shards: asked.append(items.count()) or resolve(items, shards))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert asked == [0] and {r.n_removed for r in got} == {0}


def test_merging_levels_needs_little_memory():
    rng = np.random.default_rng(1)
    n = 200_000
    a, b = (
        suffix_dedup.Level.of([bytes(x) for x in rng.integers(97, 123, (n // 85, 284), dtype=np.uint8)], np.arange(n // 85) + k, np.full(n // 85, 84))
        for k in (0, n)
    )
    windows = len(a.keys) + len(b.keys)
    tracemalloc.start()
    both = a.merged(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(both.keys) == windows and (both.keys[1:] >= both.keys[:-1]).all()
    assert sorted(both.items) == sorted([*a.items, *b.items]) and set(zip(b.keys, b.items, b.places)) <= set(zip(both.keys, both.items, both.places))
    assert peak < 30 * windows


def test_scan_finds_every_row_of_a_common_name():
    level = lambda *keys: suffix_dedup.Level(np.array(keys, dtype=np.uint64), np.arange(len(keys)), np.arange(len(keys), dtype=np.int16))
    index, noted = suffix_dedup.SuffixLevels(), []
    index.note = lambda level, hit: noted.append(level.keys[hit].tolist())
    index.scan(level(2, 2, 4, 5, 9), level(*[2] * 300, 3, 4, 4, 8, 9, 9))
    assert noted == [[2, 2, 4, 9], [2] * 300 + [4, 4, 9, 9]]


@pytest.mark.parametrize("shared_by", [50_000, 1])
def test_repeats_of_about_the_length_of_a_string(spark, monkeypatch, shared_by):
    """At the start, within and at the end of texts, with each way of comparing."""
    rng = random.Random(4)
    stock = [letters(rng, n) for n in (198, 199, 200, 201, 215, 240, 284, 285, 330, 370)]
    texts = [letters(rng, rng.choice([0, 0, 3, 90, 200])) + rng.choice(stock) + letters(rng, rng.choice([0, 0, 5, 100, 190])) for _ in range(80)]
    texts += [s[20:] + s[:150] for s in stock] + ["x" * 450, "xy" * 220, "", "short"]
    monkeypatch.setattr(suffix_dedup, "SHARED_BY", shared_by)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()) == removed(texts)
