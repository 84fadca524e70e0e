"""Work that must not grow with the square: spans of one text, items of a benchmark."""

from __future__ import annotations

import random
import re
import time

import numpy as np

from loomgraph.llm import decontamination, secrets
from loomgraph.llm.common import word_hashes
from tests.llm import cases


def test_runs_outside_of_spans():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab ") for _ in range(60))
        spans = sorted((a, a + r.randint(1, 9), "hex") for a in (r.randint(0, 55) for _ in range(r.randint(0, 8))))
        runs = list(re.finditer("[ab]+", text))
        assert [m.span() for m in secrets.outside(iter(runs), spans)] == [m.span() for m in runs if not any(s < m.end() and m.start() < e for s, e, _ in spans)]


def test_a_text_of_many_spans():
    """50,000 base spans and as many runs between them: some seconds at most, not minutes."""
    text = " ".join(f"deadbeefdeadbeef{i % 7} Zz{i:06d}QqWwEeRrTtYyUuIiOoPp" for i in range(50_000))
    began = time.time()
    spans = secrets.base_spans(text, text.lower())
    left = list(secrets.outside(secrets.RUN.finditer(text), spans))
    assert len(spans) == 50_000 == len(left) and time.time() - began < 20


def _index(items: int, words: int) -> tuple[decontamination.Index, list[tuple[int, str]]]:
    own = [(i, " ".join(cases.prose(1000 + i, words))) for i in range(items)]
    return decontamination.Index(own, {}), own


def _search(index: decontamination.Index, text: str) -> dict[int, float]:
    words, _ = word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    shingles = decontamination.grams(words, decontamination.SHINGLE)
    known, weight = index.weigh(shingles)
    return index.search(words, known, weight, shingles)


def test_time_does_not_grow_with_the_benchmark():
    """A long document that shares six words with an item, and one shorter than all items: eight times the items take less than three times as long."""
    took: dict[int, list[float]] = {}
    for items in (400, 3200):
        index, own = _index(items, 40)
        shared = " ".join(own[7][1].split()[:6])
        texts = [" ".join([*cases.prose(5, 300), shared, *cases.prose(6, 300)]), " ".join([shared, *cases.prose(8, 14)])]
        for text in texts:
            _search(index, text)
            began = time.perf_counter()
            for _ in range(20):
                assert not _search(index, text)
            took.setdefault(items, []).append(time.perf_counter() - began)
    assert all(large < 3 * small + 0.05 for small, large in zip(took[400], took[3200], strict=True)), took


def test_short_documents_find_longer_items():
    index, own = _index(50, 40)
    found = _search(index, " ".join(own[3][1].split()[:38]))
    assert set(found) == {3} and found[3] >= 0.8
    assert not _search(index, " ".join(own[3][1].split()[:20]))
