"""Homes: groups of whole documents of bounded size, dealt by a hash, where what comes back from a shuffle meets its texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_BYTES = 12 << 20
#: Homes that one task takes after another: the number of tasks grows with the homes.
HOMES_OF_TASK = 4


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of xxHash


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed_long(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash of single longs, as the SQL function xxhash64 has it."""
    h = seed + _P5 + np.uint64(8)
    h = _turned(h ^ (_turned(values.astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def home_of(homes: int, ids: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """home_column of two long columns."""
    if not len(ids):
        return np.zeros(0, np.int64)
    h = hashed_long(prints, hashed_long(ids, np.full(len(ids), 42, np.uint64)))
    return h.view(np.int64) % np.int64(homes)


def home_column(homes: int, *keys: Column) -> Column:
    """A hash of the keys, so that no pattern in the ids favours a home; with the text among them, rows of one or no id spread too."""
    return F.pmod(F.xxhash64(*keys), F.lit(homes)).cast("int")


def parts(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, the rows there in their old order)."""
    order = np.argsort(place, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        if len(rows):
            yield int(place[rows[0]]), rows
