"""Main text of web pages: boosted trees over DOM nodes, then the best choice of nodes that the tree structure allows."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import boosting, dom
from tidemark.llm.frames import map_columns
from tidemark.llm.page_layouts import MARK, Layouts

TRAINING_PAGES = 700
SEED = 23


def labelled(html: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, weights) of a page whose main text is marked; nodes without text below are left out."""
    page = dom.parse(html)
    n = len(page.parent)
    good, size, own = np.zeros(n), np.zeros(n), np.zeros(n)
    chunks = []
    for node, block, text, link in page.chunks:
        plain = text.replace(MARK, "")
        good[node] += len(plain) if MARK in text else 0
        own[node] += len(plain)
        chunks.append((node, block, plain, link))
    page.chunks = chunks
    size = own.copy()
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        size[page.parent[i]] += size[i]
    some = np.flatnonzero(size > 0)
    return dom.features(page)[some], (good[some] > 0.0).astype(float), np.where(own[some] > 0, 1.0, 0.5)


@functools.cache
def content_model(pages: int = TRAINING_PAGES, seed: int = SEED) -> boosting.Boosted:
    """Trees fitted to seeded layouts: the same model in every run."""
    layouts = Layouts(seed)
    x, y, w = (np.concatenate(v) for v in zip(*(labelled(layouts.page()) for _ in range(pages))))
    return boosting.fit(x, y, w)


def main_texts(pages: list[str | None], model: boosting.Boosted, at_once: int = 200) -> list[str]:
    out: list[str] = []
    for a in range(0, len(pages), at_once):
        parsed = [dom.parse(h or "") for h in pages[a : a + at_once]]
        found = [dom.features(p) for p in parsed]
        p = model.probabilities(np.concatenate(found))
        ends = np.cumsum([len(f) for f in found])
        for page, hi, f in zip(parsed, ends, found):
            out.append(dom.chosen_text(page, dom.decode(page, p[hi - len(f) : hi])))
    return out


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds text, the main text of each page, '' where there is none.

    Null and empty html give ''.  Every row is read on its own, whole; repeated rows get equal texts, an empty table
    stays empty, and an input column named text is replaced.
    """
    model = content_model()
    return map_columns(pages, {"text": "string"}, lambda batch: {"text": pa.array(main_texts(batch.column(column).to_pylist(), model), pa.string())}, text=column)
