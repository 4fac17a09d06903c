"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case. Numbers, names (capitalised inside a sentence) and
units (after a number) become typed placeholders, so a question keeps its windows when its
parameters change. Windows of ``SIZE`` words are hash-joined with those of the benchmark,
as they stand and as templates. A capitalised word that opens a sentence may be a name: a
second template masks it too, unless it is one of ``OPENERS``. A template holds
``LITERALS`` words as they stand; a window with fewer is carried on to the nearest ones
after it, before it, or on both sides, and is found if any of these is.

Windows of one alignment (same distance between the places in text and item) must fill the
slots consistently: an item's value always maps to one value of the text; otherwise only
the windows equal as they stand count. Second templates are judged together with the first
ones, first templates by themselves. A document is contaminated by an item if at least
``SHARE`` of the item's windows are found. An item with fewer than ``LITERALS`` words that
are no slots is any row of numbers as a template and is found only as it stands.

Plan: the benchmark is the build side, in blocks of about ``BLOCK`` words (one block for
usual sizes, more passes for more items); documents stream past it in one narrow stage,
without a shuffle, whatever their number.

Nulls, ties: null or blank texts contain nothing and are clean; null or blank items match
nothing; items with fewer than five words count as one window. Equal items are all
reported. Each row is judged by itself, so null ids and repeated rows are fine. Other
columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common

SIZE = 5
SHARE = 0.8
BLOCK = 1_000_000
LITERALS = 2
#: Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "feet", "miles", "meters",
    "metres", "kilometers", "kilometres", "mg", "g", "kg", "t", "oz", "lb", "lbs", "grams",
    "kilograms", "pounds", "tons", "ml", "cl", "l", "liters", "litres", "gallons", "s", "ms",
    "min", "h", "sec", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
    "km/h", "mph", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "kv", "a", "ma", "j", "kj",
    "k", "c", "f", "degrees", "percent", "usd", "eur", "gbp", "dollars", "cents", "euros",
)
#: Words that open sentences and are no names.
OPENERS = (
    "a", "about", "after", "all", "also", "although", "an", "and", "another", "any", "are", "as", "at",
    "because", "before", "both", "but", "by", "can", "could", "did", "do", "does", "during", "each",
    "every", "find", "for", "from", "given", "had", "has", "have", "he", "her", "here", "his", "how", "i",
    "if", "in", "is", "it", "its", "let", "many", "may", "most", "my", "next", "no", "not", "now", "of",
    "on", "one", "or", "our", "she", "should", "since", "so", "some", "that", "the", "their", "then",
    "there", "these", "they", "this", "those", "three", "to", "two", "under", "until", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whose", "why", "will", "with", "would",
    "you", "your",
)
NUMBER, NAME, UNIT = 1, 2, 3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_FLAGS = 22


def _hashes(words: tuple) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in words])
    return np.sort(common.span_hashes(data, ends - [len(u) for u in words], ends))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def tokens(data: np.ndarray, offsets: np.ndarray, units: np.ndarray, openers: np.ndarray):
    """``literal hash, kind, wide kind, row`` of every word with a letter or digit.

    A kind is that of the placeholder (0: none); the wide one has the possible names too.
    """
    starts, ends, rows = common.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int8), rows
    core = np.flatnonzero(_CORE[data])
    first, last = np.searchsorted(core, starts), np.searchsorted(core, ends) - 1
    has = first <= last
    # what stands before a word decides whether it opens a sentence
    before = np.empty(len(starts), bool)
    before[0] = True
    lines = np.cumsum(data == 10)
    before[1:] = (
        _STOP[data[ends[:-1] - 1]]
        | (rows[1:] != rows[:-1])
        | (lines[starts[1:]] != lines[ends[:-1] - 1])
    )
    a, b, rows, before = core[first[has]], core[last[has]] + 1, rows[has], before[has]
    low = common.LOWER[data]
    accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[1:][accent] += 0x20  # the Latin-1 capitals
    literal = common.span_hashes(low, a, b)
    second = data[np.minimum(a + 1, len(data) - 1)]
    capital = _UPPER[data[a]] | ((data[a] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    small = ~_UPPER[second] & (b - a > 1)
    kind = np.zeros(len(a), np.int8)
    kind[capital & small & ~before] = NAME
    number = _DIGIT[data[a]]
    kind[number] = NUMBER
    kind[1:][number[:-1] & (rows[1:] == rows[:-1]) & ~number[1:] & _member(literal[1:], units)] = UNIT
    opens = (kind == 0) & capital & small & before & ~_member(literal, openers)
    return literal, kind, np.where(opens, np.int8(NAME), kind), rows


def _spans(kind: np.ndarray, rows: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray):
    """``window, start, end`` of the word runs with LITERALS literals that stand for windows with slots."""
    words = np.flatnonzero(kind == 0)
    before, after = np.searchsorted(words, first), np.searchsorted(words, first + size)
    need = LITERALS - (after - before)
    slots = (after - before) < size
    at = np.flatnonzero(slots & (need <= 0))
    out = [(at, first[at], first[at] + size[at])]
    at = np.flatnonzero(slots & (need > 0))
    for left in range(LITERALS + 1):  # literals taken from before the window, the others from after it
        w = at[need[at] >= left]
        lo, hi = before[w] - left, after[w] + need[w] - left - 1
        w, lo, hi = (x[(lo >= 0) & (hi < len(words))] for x in (w, lo, hi))
        right = need[w] > left
        start = words[lo] if left else first[w]
        end = np.where(right, words[hi] + 1, first[w] + size[w])
        inside = (rows[start] == row[w]) & (rows[end - 1] == row[w])
        out.append((w[inside], start[inside], end[inside]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keys(masked: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    forth, back = common._tables(len(masked) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(masked * forth[: len(masked)], dtype=np.uint64)])
    return ~common.mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def windows(literal: np.ndarray, kind: np.ndarray, wide: np.ndarray, rows: np.ndarray, n_rows: int):
    """``row, first word`` of every window, and ``key, window, start, end, form`` of what finds it.

    Forms: 0 as it stands, 1 its template, 2 its template with possible names.
    """
    plain, row, first = common.shingles(literal, rows, n_rows, SIZE)
    size = np.minimum(SIZE, np.bincount(rows, minlength=n_rows)[row])
    placeholder = common.mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    found = [(plain, np.arange(len(plain)), first, first + size, np.zeros(len(plain), np.int8))]
    more = np.concatenate([[0], np.cumsum(wide != kind)])
    for form, kinds in ((1, kind), (2, wide)):
        window, start, end = _spans(kinds, rows, row, first, size)
        if form == 2:  # the others are first templates already
            window, start, end = (x[more[end] > more[start]] for x in (window, start, end))
        key = _keys(np.where(kinds > 0, placeholder[kinds], literal), start, end)
        found.append((key, window, start, end, np.full(len(key), form, np.int8)))
    return row, first, tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Block:
    """The windows of some benchmark items, ready to be probed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.units, self.openers = _hashes(UNITS), _hashes(OPENERS)
        self.literal, self.kind, self.wide, rows = tokens(data, offsets, self.units, self.openers)
        row, first, (key, window, start, end, form) = windows(
            self.literal, self.kind, self.wide, rows, len(texts)
        )
        self.total = np.bincount(row, minlength=len(texts))
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.end, self.form = key[order], start[order], end[order], form[order]
        self.item, self.first = row[window[order]], first[window[order]]
        self.flags = np.zeros(1 << _FLAGS, bool)
        self.flags[self.key & np.uint64((1 << _FLAGS) - 1)] = True

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """``(row, item)`` for every text of the slice that contains an item."""
        n = len(offsets) - 1
        literal, kind, wide, rows = tokens(data, offsets, self.units, self.openers)
        row, _, (key, window, start, _, _) = windows(literal, kind, wide, rows, n)
        at = np.flatnonzero(self.flags[key & np.uint64((1 << _FLAGS) - 1)])
        lo = np.searchsorted(self.key, key[at])
        count = np.searchsorted(self.key, key[at], "right") - lo
        entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(at, count)
        if not len(at):
            return []
        row, item, item_first, form = row[window[at]], self.item[entry], self.first[entry], self.form[entry]
        good = form == 0
        masked = ~good
        if masked.any():
            good[masked] = self._consistent(row[masked], entry[masked], start[at[masked]], literal)
        found = np.unique(np.stack([row[good], item[good], item_first[good]], 1), axis=0)
        pairs, count = np.unique(found[:, :2], axis=0, return_counts=True)
        enough = count >= SHARE * self.total[pairs[:, 1]]
        return [(int(r), int(i)) for r, i in pairs[enough]]

    def _consistent(self, row, entry, start, literal) -> np.ndarray:
        """Which templates lie in an alignment whose slots are filled consistently."""
        where = np.stack([row, self.item[entry], start - self.start[entry]], 1)
        places, group = np.unique(where, axis=0, return_inverse=True)
        group = group.ravel()
        form = self.form[entry]
        fillings, good = [], np.zeros(len(group), bool)
        for k, kinds in ((1, self.kind), (2, self.wide)):
            use = form == k
            g, mine = _covered(group[use], self.start[entry[use]], self.end[entry[use]])
            slot = (kinds[mine] > 0) & (kinds[mine] != UNIT)
            g, mine = g[slot], mine[slot]
            theirs = literal[mine + places[g, 2]]
            fillings.append(np.stack([g.astype(np.uint64), self.literal[mine], theirs], 1))
            maps = np.unique(np.concatenate(fillings), axis=0)
            bad = np.zeros(len(places), bool)
            twice = (maps[1:, 0] == maps[:-1, 0]) & (maps[1:, 1] == maps[:-1, 1])
            bad[maps[1:, 0][twice].astype(np.int64)] = True
            good[use] = ~bad[group[use]]
        return good


def _covered(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``group, place`` of all that the runs of each group cover, each place once."""
    if not len(group):
        return group, start
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    far = end.max() + 1
    reach = np.maximum.accumulate(group * far + end)
    begin = group * far + start
    begin[1:] = np.maximum(begin[1:], reach[:-1])
    size = np.maximum(0, reach - begin)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return at // far, at % far


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK words; only one is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "text IS NOT NULL AND item_id IS NOT NULL"
    )
    total = items.agg(F.sum(F.regexp_count("text", F.lit(common.WORD)))).first()[0] or 0
    n = -(-total // BLOCK)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Block([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()])


def _match(docs: DataFrame, block: Block, column: str) -> DataFrame:
    """Adds the ids of the block's items found in each text to the list in ``column``."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        held = sent.value
        for batch in batches:
            found = [list(x) for x in batch.column(column).to_pylist()]
            base = 0
            for part, data, offsets in common.slices(batch, "text"):
                for row, item in held.matches(data, offsets):
                    found[base + row].append(int(held.ids[item]))
                base += part.num_rows
            columns = [
                pa.array([sorted(set(x)) for x in found], pa.list_(pa.int64()))
                if name == column
                else batch.column(name)
                for name in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``_items``: the sorted ids of the benchmark items a text contains."""
    out = docs.withColumn("_items", F.array().cast("array<long>"))
    for block in blocks(benchmark):
        out = _match(out, block, "_items")
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids`` for every row of ``docs``."""
    return contaminated(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        (F.size("_items") > 0).alias("contaminated"),
        F.size("_items").cast("long").alias("n_items"),
        F.col("_items").alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item of the benchmark."""
    plain = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return contaminated(plain, benchmark).where(F.size("_items") == 0).select("_doc.*")
