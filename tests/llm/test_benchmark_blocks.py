"""A benchmark of many blocks: one is held at a time, and no decision depends on how it is cut."""

import random

import pytest

from tidemark.llm import decontamination


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, sentence(rng.randint(12, 30))) for i in range(120)] + [(200, "yes"), (201, "the answer"), (202, "?!"), (203, None), (None, "no id here at all and long enough")]
    docs = [(i, sentence(60)) for i in range(60)]
    docs += [(100 + i, f"{sentence(20)} {items[3 * i][1]} {sentence(20)}") for i in range(30)]
    docs += [(300, "Yes."), (301, "yes and more of it"), (302, "the answer"), (303, "?!"), (304, None), (305, ""), (None, items[5][1]), (None, sentence(30)), (110, sentence(25))]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), docs, items


def brute(docs, items):
    """Indices of documents that hold an item word for word, or are a short one."""
    strip = lambda t: [w for w in (x.strip(".?!").lower() for x in (t or "").split()) if w]
    held = set()
    for k, (_, text) in enumerate(docs):
        own = strip(text)
        for i, item in items:
            want = strip(item)
            if i is None or not want:
                continue
            inside = any(own[a : a + len(want)] == want for a in range(len(own) - len(want) + 1))
            if own == want if len(want) < 4 else inside:
                held.add(k)
    return held


def test_all_cuts_keep_the_same_documents(tables):
    docs, benchmark, rows, items = tables
    held = brute(rows, items)
    assert len(held) == 33
    want = sorted((r for k, r in enumerate(rows) if k not in held), key=str)
    for block_bytes in (1 << 20, 2_000, 300):
        kept = decontamination.without_contaminated(docs, benchmark, block_bytes).collect()
        assert sorted((tuple(r) for r in kept), key=str) == want, block_bytes


def test_plan_does_not_grow_with_the_blocks(tables, monkeypatch):
    docs, benchmark, _, _ = tables
    held = []
    made = decontamination.benchmark_of
    monkeypatch.setattr(decontamination, "benchmark_of", lambda rows: held.append(sum(len(t) for _, t in rows)) or made(rows))
    out = decontamination.without_contaminated(docs, benchmark, 300)
    assert len(held) > 15 and max(held) < 2_000
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_short_items_are_found_whole(tables):
    docs, benchmark, _, _ = tables
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, benchmark).where("item_id >= 200").collect()}
    assert set(found) == {(300, 200), (302, 201)}
    r = found[302, 201]
    assert (r.n_windows, r.cover, r.literal, r.from_word, r.to_word, r.n_alike) == (1, 1.0, True, 0, 2, 1)


def test_empty_benchmarks_keep_everything(tables):
    docs, benchmark, rows, _ = tables
    assert decontamination.without_contaminated(docs, benchmark.where("false")).count() == len(rows)
    assert decontamination.without_contaminated(docs.where("false"), benchmark, 300).count() == 0
