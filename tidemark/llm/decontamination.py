"""Benchmark decontamination by template windows.

Words become canonical tokens: lower-case, without punctuation at the ends; numbers, units and names within a sentence
become typed placeholders, runs of names and a number with its unit a single one; a second template form takes capitalised
words at the start of sentences for names too.  Windows of eight tokens of every item, in literal and both template
forms, are hash-joined with those of every document.  Windows met join up to stretches, and stretches of neighbouring
alignments to chains, so words put in, changed or left out don't break an item up.  A document
holds an item if a chain covers half of the item's windows or half of its tokens (13 at least in template form), or if 13
literal tokens stand in one stretch.  For templates each filler of the item always stands for the same filler of the
document: that catches questions whose numbers, names or units were changed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import map_columns
from tidemark.llm.storage import written
from tidemark.llm.tokens import Words, blocks, mix, segment_hashes

WIDTH = 8
LEAST_WIDTH = 4
LEAST_LITERALS = 4
LEAST_COVER = 0.5
#: Literal tokens in one unbroken stretch that count whatever share of the item they are.
LEAST_RUN = 13
#: Benchmark text held by a task at once; a larger benchmark is taken in blocks of whole items.
BLOCK_BYTES = 8 << 20

# Words for numbers and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles g mg kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years cent cents dollar dollars euro euros usd eur degree degrees celsius fahrenheit kelvin percent mph kph watt watts volt volts amp amps joule joules newton newtons hz khz mhz ghz byte bytes kb mb gb tb".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_NUMBER_UNIT = re.compile(r"[+-]?[$€£]?(\d[\d.,]*)([a-z]+)")
LITERAL, NUMBER, UNIT, NAME, NUMBER_UNIT = range(5)
_PLACEHOLDER = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x4444444444444444], np.uint64)


def _trim(word: str) -> str:
    a, b = 0, len(word)
    while a < b and unicodedata.category(word[a])[0] == "P":
        a += 1
    while b > a and unicodedata.category(word[b - 1])[0] == "P" and word[b - 1] != "%":
        b -= 1
    return word[a:b]


def kind_of(word: str) -> tuple[str, int, bool]:
    """(canonical token, kind, whether a sentence ends after it); a capitalised word is a NAME."""
    ends = word[-1:] in ".!?:" or word[-2:-1] in (".", "!", "?")
    body = word if word.isalnum() else _trim(word)
    low = body.lower()
    if low[:1].isdigit() or low[:1] in "+-$€£":
        if _NUMBER.fullmatch(low):
            return low, NUMBER, ends
        if (m := _NUMBER_UNIT.fullmatch(low)) and m[2] in UNITS:
            return low, NUMBER_UNIT, ends
    if low in NUMBER_WORDS:
        return low, NUMBER, ends
    if low in UNITS:
        return low, UNIT, ends
    return low, NAME if body[:1].isupper() and body[1:2].islower() else LITERAL, ends


@dataclass
class Stream:
    """Tokens of a block's texts in one form: hashes, whether literal, the words they stand for, and first of each text."""

    hashes: np.ndarray
    literal: np.ndarray
    word: np.ndarray
    first: np.ndarray

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, position) of the windows with enough literal tokens."""
        n = np.maximum(np.diff(self.first) - width + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        position = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = self.first[:-1][text] + position
        sums = np.concatenate(([0], np.cumsum(self.literal)))
        ok = sums[at + width] - sums[at] >= min(LEAST_LITERALS, width)
        at = at[ok]
        return mix(segment_hashes(self.hashes, at, at + width), 40 + width), text[ok], position[ok]


def streams(words: Words) -> tuple[Stream, Stream, Stream]:
    """The literal form of a block, its template form, and that with capitalised words as names at a sentence's start too; punctuation alone is no token."""
    hashes = words.hashes()
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    found = [kind_of(raw[s:e].decode("utf-8", "replace")) for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())]
    code = np.array([xxhash.xxh64_intdigest(t) for t, _, _ in found], np.uint64)[inverse] if len(found) else np.zeros(0, np.uint64)
    kind = np.array([k for _, k, _ in found], np.int64)[inverse] if len(found) else np.zeros(0, np.int64)
    ends = np.array([e for _, _, e in found], bool)[inverse] if len(found) else np.zeros(0, bool)
    empty = np.array([not t for t, _, _ in found], bool)[inverse] if len(found) else np.zeros(0, bool)
    begins = np.zeros(len(kind), bool)
    begins[1:] = ends[:-1]
    begins[words.first[:-1][words.counts > 0]] = True

    def form(codes: np.ndarray, literal: np.ndarray, keep: np.ndarray) -> Stream:
        number = np.concatenate(([0], np.cumsum(keep)))
        word = np.flatnonzero(keep)
        return Stream(codes[word], literal[word].astype(np.int64), word, number[words.first])

    plain = form(code, np.ones(len(code), bool), ~empty)
    start = np.zeros(len(kind), bool)
    start[words.first[:-1][words.counts > 0]] = True
    next_start = np.concatenate((start[1:], [True])) if len(kind) else start

    def template(kind: np.ndarray) -> Stream:
        previous = np.concatenate(([LITERAL], kind[:-1])) if len(kind) else kind
        following = np.concatenate((kind[1:], [LITERAL])) if len(kind) else kind
        fused = (kind == NUMBER) & (following == UNIT) & ~next_start
        dropped = ~start & (((kind == NAME) & (previous == NAME)) | ((kind == UNIT) & (previous == NUMBER)))
        kind = np.where(fused, NUMBER_UNIT, kind)
        return form(np.where(kind == LITERAL, code, _PLACEHOLDER[kind]), kind == LITERAL, ~empty & ~dropped)

    return plain, template(np.where((kind == NAME) & begins, LITERAL, kind)), template(kind)


@dataclass
class Item:
    item_id: int
    windows: list[int]  # how many in each form
    fillers: list[list[str | None]]  # of its tokens in each form; None: literal
    leads: int  # the first item of the same template, itself or another
    alike: int = 1  # how many items have it


@dataclass
class Benchmark:
    """A block of items: for each form and width, sorted window hashes with the item and position of each."""

    items: list[Item]
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: dict[tuple[int, ...], list[int]]  # the tokens of items that have no windows, and which items they are


def _fillers(words: Words, template: Stream, at: range, end: int) -> list[str | None]:
    """What stands in each placeholder: all its words, canonical, joined; None for a literal token.  end: the text's last word + 1."""
    raw = words.data.tobytes()
    out: list[str | None] = []
    bounds = [*template.word[at.start : at.stop + 1].tolist(), end]
    for k, i in enumerate(at):
        if template.literal[i]:
            out.append(None)
            continue
        last = min(bounds[k + 1], end)
        spans = zip(words.starts[bounds[k] : last].tolist(), words.ends[bounds[k] : last].tolist())
        out.append(" ".join(filter(None, (_trim(raw[s:e].decode("utf-8", "replace")).lower() for s, e in spans))))
    return out


def _pattern(fillers: list[str | None]) -> tuple[int, ...]:
    """Where each filler stands first: items of one pattern agree with the same texts, whatever their fillers are."""
    first: dict[str, int] = {}
    return tuple(-1 if x is None else first.setdefault(x, i) for i, x in enumerate(fillers))


def benchmark_of(rows: list[tuple[int, str]]) -> Benchmark:
    """The windows of these items in all forms; items of one template share its windows, so a templated benchmark is no larger for its copies."""
    items: list[Item] = []
    templates: dict[tuple, int] = {}
    short: dict[tuple[int, ...], list[int]] = defaultdict(list)
    found: dict[tuple[int, int], list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
    for item_id, text in rows:
        for _, _, words in blocks(pa.array([text])):
            forms = streams(words)
            counts = []
            if 0 < len(forms[0].hashes) < LEAST_WIDTH:
                short[tuple(forms[0].hashes.tolist())].append(len(items))
            fillers = [_fillers(words, stream, range(len(stream.hashes)), int(words.first[-1])) for stream in forms]
            template = tuple(x for stream, own in zip(forms[1:], fillers[1:]) for x in (stream.hashes.tobytes(), _pattern(own)))
            lead = templates.setdefault(template, len(items))
            if lead < len(items):
                items[lead].alike += 1
            for f, stream in enumerate(forms):
                width = min(WIDTH, int(stream.first[-1]))
                hashes, _, position = stream.windows(width) if width >= LEAST_WIDTH else (np.zeros(0, np.uint64), None, np.zeros(0, np.int64))
                counts.append(len(hashes))
                if len(hashes) and (f == 0 or lead == len(items)):
                    found[f, width].append((hashes, len(items), position))
            items.append(Item(item_id, counts, fillers, lead))
    tables = {}
    for key, parts in found.items():
        hashes = np.concatenate([h for h, _, _ in parts])
        order = np.argsort(hashes, kind="stable")
        owner = np.concatenate([np.full(len(h), i) for h, i, _ in parts])
        tables[key] = (hashes[order], owner[order], np.concatenate([p for _, _, p in parts])[order])
    return Benchmark(items, tables, dict(short))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark as blocks of items of about block_bytes of text: the driver and the tasks hold one block at a time."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = block_count(items, block_bytes)
    if n > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), "benchmark-blocks", by=["block"])
    for b in range(n):
        rows = (items.where(F.col("block") == b) if n > 1 else items).select("item_id", "text").collect()
        if rows:
            yield benchmark_of(sorted((int(r["item_id"]), r["text"]) for r in rows))


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"] // block_bytes + 1


@dataclass
class Piece:
    """A stretch of tokens that text and item share: where it starts in both, the windows met (offsets), and its fillers."""

    text: int
    place: int
    length: int
    windows: list[int]
    literals: int
    names: dict[str, str | None]


def _pieces(hits: list[tuple[int, int]], width: int, item: list[str | None], words: Words, stream: Stream, t: int) -> list[Piece]:
    """The stretches that windows met at (position, place) join up to, without those in which a filler stands for two."""
    by_shift: dict[int, list[int]] = defaultdict(list)
    for position, place in hits:
        by_shift[position - place].append(position)
    out = []
    base, end = int(stream.first[t]), int(words.first[t + 1])
    for shift, positions in by_shift.items():
        positions.sort()
        cuts = [0, *[k for k in range(1, len(positions)) if positions[k] > positions[k - 1] + width], len(positions)]
        for a, b in zip(cuts, cuts[1:]):
            start, stop = positions[a], positions[b - 1] + width
            at = range(base + start, base + stop)
            own = item[start - shift : stop - shift]
            names: dict[str, str | None] = {}
            fillers = _fillers(words, stream, at, end) if any(x is not None for x in own) else own
            if all(x is None or names.setdefault(x, y) == y for x, y in zip(own, fillers)):
                out.append(Piece(start, start - shift, stop - start, [p - start for p in positions[a:b]], sum(x is None for x in own), names))
    return out


def _chains(pieces: list[Piece], size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(tokens, windows, longest run of literals, from, to) of the best chain that ends in each piece.

    A chain goes forward in text and item, its alignment shifts by at most the item's size at once (words put in, changed or
    left out), and its fillers agree.  What two pieces share counts once.
    """
    pieces = sorted(pieces, key=lambda x: (x.text, x.place))
    best: list[tuple[int, int, int, int, dict[str, str | None]]] = []
    for j, b in enumerate(pieces):
        top = (b.length, len(b.windows), b.literals, b.text, b.names)
        for i in range(j - 1, -1, -1):
            a = pieces[i]
            if b.text - a.text > 2 * size:
                break
            over = max(0, a.text + a.length - b.text, a.place + a.length - b.place)
            if a.text == b.text or a.place >= b.place or over >= b.length or abs((b.text - b.place) - (a.text - a.place)) > size:
                continue
            tokens, windows, run, start, names = best[i]
            last = max(a.text + a.windows[-1] - b.text, a.place + a.windows[-1] - b.place)
            met = windows + sum(x > last for x in b.windows)
            if (tokens + b.length - over, met) > top[:2] and all(names.get(k, v) == v for k, v in b.names.items()):
                top = (tokens + b.length - over, met, max(run, b.literals), start, names | b.names)
        best.append(top)
        yield (*top[:4], b.text + b.length)


def matches(words: Words, bench: Benchmark) -> list[tuple[int, int, int, float, bool, int, int, int]]:
    """(text, item_id, windows met, cover, literal, from word, to word, items alike) of what a text of the block holds.

    Of the items of one template those held whole, word for word, each count; without such the best met alone does.
    """
    forms = streams(words)
    best: dict[tuple[int, int], tuple] = {}
    for (form, width), (hashes, owner, place) in bench.tables.items():
        own, text, position = forms[form].windows(width)
        lo = np.searchsorted(hashes, own)
        hit = np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == own))
        met: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for i in hit.tolist():
            for k in range(lo[i], np.searchsorted(hashes, own[i], side="right")):
                met[int(text[i]), int(owner[k])].append((int(position[i]), int(place[k])))
        stream = forms[form]
        for (t, o), hits in met.items():
            item = bench.items[o]
            size = len(item.fillers[form])
            for tokens, n, run, a, b in _chains(_pieces(hits, width, item.fillers[form], words, stream, t), size):
                cover = min(n / item.windows[form], 1.0)
                half = tokens >= LEAST_COVER * size and (form == 0 or tokens >= LEAST_RUN)
                if not (half or cover >= LEAST_COVER or run >= LEAST_RUN):
                    continue
                if (t, o) not in best or cover > best[t, o][3]:
                    base, at = int(words.first[t]), int(stream.first[t])
                    best[t, o] = (t, item.item_id, n, cover, form == 0, int(stream.word[at + a]) - base, int(stream.word[at + b - 1]) + 1 - base, 1 if form == 0 else item.alike)
    classes: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for t, o in sorted(best):
        classes[t, bench.items[o].leads].append((t, o))
    kept = []
    for own in classes.values():
        whole = [k for k in own if best[k][4] and best[k][3] >= 1]
        kept += whole or [max(own, key=lambda k: (best[k][3], best[k][4], -k[1]))]
    return [best[k] for k in sorted(kept)] + _short_matches(words, forms[0], bench)


def _short_matches(words: Words, plain: Stream, bench: Benchmark) -> list[tuple[int, int, int, float, bool, int, int, int]]:
    """Texts that are a short item and nothing else."""
    if not bench.short:
        return []
    size, out = np.diff(plain.first), []
    for t in np.flatnonzero((size > 0) & (size < LEAST_WIDTH)).tolist():
        a, b = int(plain.first[t]), int(plain.first[t + 1])
        base = int(words.first[t])
        span = (int(plain.word[a]) - base, int(plain.word[b - 1]) + 1 - base)
        out += [(t, bench.items[o].item_id, 1, 1.0, True, *span, 1) for o in bench.short.get(tuple(plain.hashes[a:b].tolist()), ())]
    return out


_MATCHES = "doc_id long, item_id long, n_windows long, cover double, literal boolean, from_word long, to_word long, n_alike long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, cover, literal, from_word, to_word, n_alike): what a document's whole text holds.

    Items of one template give a row for each that is held whole, word for word, else one row for the best met; n_alike is
    1 in literal form, else how many items have the template, which then stands under its first item_id.

    cover is the share of the item's windows met in one chain, small where a quoted stretch alone counts;
    literal tells that they were met word for word; from_word and to_word bound what was met.
    Null texts and items hold nothing.  Items of fewer than four tokens can't be told from ordinary text within a longer
    one: a document holds such an item where its tokens are all it has.  Rows of equal doc_id are told of together, null doc_ids as null; items of equal item_id are one row.  Empty tables give no rows.
    """
    done, now = [], None
    for block in benchmark_blocks(benchmark):
        if now is not None:  # written before the next but one block is read: the driver never holds more than two
            done.append(written(now, "matches"))
        now = _against(docs, block)
    if now is None:
        return docs.sparkSession.createDataFrame([], _MATCHES)
    return reduce(DataFrame.unionByName, [*done, now])


def _against(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """All documents against one block of items of about BLOCK_BYTES, which every task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, words in blocks(batch.column("text")):
                rows = matches(words, bench)
                if rows:
                    ids = batch.column("doc_id").take(pa.array([lo + r[0] for r in rows]))
                    columns = list(zip(*rows))[1:]
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", "item_id", "n_windows", "cover", "literal", "from_word", "to_word", "n_alike"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MATCHES)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item; a row without a doc_id is judged by its text like any other.

    A benchmark of one block filters where the documents are.  Of a larger one, each block's hashes of the documents that
    hold its items are written before the next block is read, and those documents leave by one anti-join.
    """

    def held_rows(batch: pa.RecordBatch, bench: Benchmark) -> np.ndarray:
        held = np.zeros(batch.num_rows, bool)
        for lo, _, words in blocks(batch.column("text")):
            held[[lo + r[0] for r in matches(words, bench)]] = True
        return held

    if block_count(benchmark.where("text is not null and item_id is not null"), block_bytes) == 1:
        for bench in benchmark_blocks(benchmark, block_bytes):
            docs = map_columns(docs, {"__held": "boolean"}, lambda batch, bench=bench: {"__held": pa.array(held_rows(batch, bench))}).where(~F.col("__held")).drop("__held")
        return docs
    keys = {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "text", "doc_id")}
    keyed, gone = docs.select("text", *[v.alias(k) for k, v in keys.items()]), []
    for bench in benchmark_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(["__k1", "__k2"]).filter(pa.array(held_rows(batch, bench)))

        gone.append(written(keyed.mapInArrow(run, "__k1 long, __k2 long"), "held-documents"))
    return docs.withColumns(keys).join(reduce(DataFrame.unionByName, gone).distinct(), list(keys), "left_anti").select(*docs.columns)
