"""What training takes of the driver."""

import tracemalloc

import numpy as np

from tidemark.llm import toxicity


def test_training_does_not_hold_words_without_weight():
    chance = np.random.RandomState(3)
    rows = [(i % 2, np.append(np.sort(chance.choice(200_000, 10_000, False)), 200_000 + i % 2).astype(np.int32), np.array([10_001], np.int32)) for i in range(200)]
    tracemalloc.start()
    try:
        bias, weights = toxicity.fit(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert weights[200_001] > 0 > weights[200_000]  # what tells the labels apart
    assert most < 60e6  # the words as 64-bit numbers, once, are 16 MB
