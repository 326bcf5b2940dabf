"""What the driver holds at once: the kept arrays of training and the plan of a mix."""

import tracemalloc

import numpy as np
import pytest

from tidemark.llm import gru, mixing
from tidemark.llm.tokens import words_of


def _texts(n: int, n_words: int):
    rng = np.random.default_rng(1)
    for _ in range(n):
        data = np.frombuffer(" ".join(f"word{x}" for x in rng.integers(0, 5000, n_words)).encode(), np.uint8)
        yield words_of(data, np.array([0, len(data)]))


def test_training_keeps_few_bytes_of_each_text():
    size = sum(len(w.data) for w in _texts(400, 600))
    tracemalloc.start()
    gru.train(_texts(400, 600), np.arange(400) % 2, steps=1, batch=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * size + 16_000_000  # tables, their moments and means apart


def test_narrow_arrays_hold_the_same_numbers():
    for words in [*_texts(3, 700), words_of(np.zeros(0, np.uint8), np.zeros(2, np.int64))]:
        vocab, inverse, *windows = gru._narrow(words)
        whole, at = gru.vocabulary(words)
        wide = [whole.word, whole.grams, whole.first, at, *gru.window_spans(words.first)]
        assert all(np.array_equal(a, b) for a, b in zip([vocab.word, vocab.grams, vocab.first, inverse, *windows], wide))


@pytest.mark.parametrize("rows", [0, 40])
def test_a_mix_is_planned_in_parts(spark, rows):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), "xyz"[i % 3]) for i in range(rows)], "doc_id long, text string, source string")
    found = mixing.mix(docs, block=4).documents
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 0
    assert plan.count("FileScan") <= 6
    assert found.count() == rows
