"""Vectorised words, hashes and shingles over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses those bytes inside a
longer code point, so bytes and code points agree.  Everything here works on a bounded block of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 21

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_CODE = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Two hashes that know nothing of each other: base, its inverse, and codes of the bytes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_BYTE_CODES = (_BYTE_CODE, np.random.default_rng(20240602).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
#: Longer words go through a cryptographic hash: a polynomial modulo 2**64 can be made to collide on words of 1,024 bytes.
LONG_WORD = 64
#: Values that are hashed at once.
SPAN = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another salt gives an independent hash."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, codes: np.ndarray | None = None) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of values[start:end] of each segment, from prefix sums; of codes[values] where codes are given.

    Segments come by ascending start and end; they are taken in stretches of about SPAN values, so memory doesn't grow with values.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SPAN, side="right")))
        span = values[base : int(ends[hi - 1])]
        span = span if codes is None else codes[span]
        sums = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(span * _powers(_BASES[which], len(span)), dtype=np.uint64, out=sums[1:])
        at = starts[lo:hi] - base
        out[lo:hi] = (sums[ends[lo:hi] - base] - sums[at]) * _powers(_INVERSES[which], len(span) + 1)[at]
        lo = hi
    return out


@dataclass
class Words:
    """The words of a block of texts: byte spans in data, and words[first[i]:first[i + 1]] are text i's."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        return mix(segment_hashes(data, self.starts, self.ends, codes=_BYTE_CODE))

    def strong_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each word, on which two words of any length collide by chance alone."""
        both = tuple(mix(segment_hashes(self.data, self.starts, self.ends, i, _BYTE_CODES[i]), 5 * i) for i in (0, 1))
        for k in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.starts[k] : self.ends[k]].tobytes(), digest_size=16).digest()
            both[0][k], both[1][k] = np.frombuffer(digest, np.uint64)
        return both

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, position) of every window of so many consecutive words of one text."""
        n = np.maximum(self.counts - width + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        position = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = self.first[:-1][text] + position
        return mix(segment_hashes(hashes, at, at + width), 1), text, position

    def second_windows(self, hashes: np.ndarray, text: np.ndarray, position: np.ndarray, width: int) -> np.ndarray:
        """A hash of the same windows independent of the first one, from the words' second hashes."""
        at = self.first[:-1][text] + position
        return mix(segment_hashes(hashes, at, at + width, 1), 6)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) of runs of texts of about so many bytes; a longer text is a run of its own. Null: no words."""
    data, offsets = string_buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_SEPARATOR[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def numbered(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words of the block and only for those: by the bytes, not by a hash."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    ends = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=ends[1:])
    spelt = pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(ends), pa.py_buffer(words.data[~_SEPARATOR[words.data]])])
    return spelt.dictionary_encode().indices.to_numpy().astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as one compressed payload: byte planes of 8-byte integers, deltas for all but the first."""
    n = len(columns[0])
    planes = [np.asarray(columns[0], np.uint64)]
    planes += [np.diff(np.asarray(c, np.int64), prepend=np.int64(0)).view(np.uint64) for c in columns[1:]]
    random = planes[0].tobytes()
    rest = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(n, 8).T).tobytes() for p in planes[1:])
    squeezed = pa.compress(rest, codec="zstd", asbytes=True) if rest else b""
    return n.to_bytes(8, "little") + random + squeezed


def unpack(payload: bytes, n_columns: int) -> list[np.ndarray]:
    n = int.from_bytes(payload[:8], "little")
    columns = [np.frombuffer(payload, np.uint64, n, 8)]
    if n_columns > 1:
        rest = pa.decompress(payload[8 + 8 * n :], decompressed_size=8 * n * (n_columns - 1), codec="zstd", asbytes=True)
        planes = np.frombuffer(rest, np.uint8).reshape(n_columns - 1, 8, n)
        columns += [np.cumsum(np.ascontiguousarray(p.T).view(np.int64).ravel()) for p in planes]
    return columns
