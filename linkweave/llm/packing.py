"""Best-fit packing of whole documents into sequences of a fixed length.

A document's ids end with ``end``; only a longer document is cut, into pieces of the
sequence length and a rest. Bounded-space online best-fit: a task streams its pieces and
keeps at most ``OPEN`` bins open. The free spaces of the open bins are bits of one
integer, so the tightest bin that still takes a piece is the lowest set bit from the
piece's length on, whatever the number of bins. When a piece fits nowhere and all bins
are in use, the fullest closes first; a bin without free space closes at once. Pieces
of a slab of texts, and those of open bins, come longest first.

Scale: the first pass tokenises and packs where the table is read, without a shuffle, and
holds ``OPEN`` bins at a time. The bins a task leaves open go back to being pieces: ``FAN``
tasks' pieces are streamed through one task of the next level, which again leaves at most
``OPEN`` bins, until one task is left. So each task of a level reads at most FAN * OPEN
sequences at any size, and all the waste of open bins is that of the last task. Levels are
written tables, so a lost executor repeats its own tasks.

Nulls, ties: a null or empty text is ``end`` alone; a null id is packed as null; repeated
rows count each; an empty table gives no rows; a longer text than a sequence keeps all its
ids. Strings of special tokens inside texts are recognised by the tokenizer as it does.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common, tokens

CAPACITY = 2048
OPEN = 256
FAN = 16
FLUSH = 8 << 20
_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids binary, "
    "sequence_id long, offset long, closed boolean, part long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()),
        ("offset", pa.int64()), ("closed", pa.bool_()), ("part", pa.int64()),
    ]
)


class Bins:
    """Open bins by free space; closed ones come out as rows."""

    def __init__(self, capacity: int, space: int, part: int, level: int):
        self.capacity, self.space, self.part = capacity, space, part
        self.bits = 0  # bit f: an open bin has f places free
        self.by_free: dict[int, list[list]] = {}
        self.open = 0
        self.number = (level << 58) | (part << 32)
        self.rows: list[tuple] = []
        self.bytes = 0

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def _close(self, pieces: list, closed: bool) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((*p, self.number, offset, closed, self.part))
            offset += p[3]
        self.bytes += 4 * offset + 64 * len(pieces)
        self.number += 1

    def add(self, piece: tuple) -> None:
        """Places ``(doc_id, piece, start, length, ids)``; length is at most the capacity."""
        n = piece[3]
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            into = self._take(free)
        else:
            if self.open == self.space:  # the fullest closes first
                self._close(self._take((self.bits & -self.bits).bit_length() - 1), True)
                self.open -= 1
            free, into = self.capacity, []
            self.open += 1
        into.append(piece)
        free -= n
        if free:
            self.by_free.setdefault(free, []).append(into)
            self.bits |= 1 << free
        else:
            self._close(into, True)
            self.open -= 1

    def leave(self) -> None:
        """What is open comes out as not closed."""
        while self.bits:
            self._close(self._take((self.bits & -self.bits).bit_length() - 1), False)
        self.open = 0

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in _ARROW]
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )
        self.rows, self.bytes = [], 0
        return out


def texts_ids(texts: pa.Array, memo: tokens.Memo, path: str) -> Iterator[tuple[int, bytes]]:
    """``row, ids`` of each text of an array, a slab at a time between Nones."""
    special = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
    data, offsets = common.flat(texts)
    first, n = 0, len(texts)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + tokens.SLAB, "right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first : last + 1] - offsets[first]
        part, own, cuts = tokens.words(data[offsets[first] : offsets[last]], own)
        if len(part):
            ids, lengths = tokens.gather(*memo(part, cuts))
            # a text's ids end where the last chunk that lies in it ends
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(cuts, own)] * 4
            flat = ids.tobytes()
        else:
            ends, flat = np.zeros(len(own), np.int64), b""
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            yield first + k, flat[a:b]
        yield from ((int(k), None) for k in special if first <= k < last)
        yield -1, b""
        first = last


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0, space: int = OPEN
) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``, one row per piece.

    ``ids`` are little-endian unsigned 32-bit numbers, ``end`` included.
    """
    path = path or tokens.file_of("word_bpe_49k.json")
    last = np.array([end], "<u4").tobytes()

    def encode(chunks: list[bytes]) -> list[bytes]:
        return tokens.packed(tokens.word_ids(path, chunks))

    def pieces(doc_id, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        for k, at in enumerate(range(0, n, capacity)):
            yield doc_id, k, at, min(capacity, n - at), ids[4 * at : 4 * (at + capacity)]

    def first(batches):
        bins = Bins(capacity, space, TaskContext.get().partitionId(), 0)
        memo = tokens.Memo(encode)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            slab: dict[int, bytes] = {}
            for row, found in texts_ids(texts, memo, path):
                if row >= 0:
                    if found is None:  # special tokens: the whole text at once
                        whole = texts[row].cast(pa.binary()).as_py().decode("utf-8", "replace")
                        found = tokens.packed(tokens.batch(tokens.loaded("word", path), [whole]))[0]
                    slab[row] = found
                    continue
                some = [p for r, x in slab.items() for p in pieces(ids[r], x + last)]
                some.sort(key=lambda p: -p[3])
                for p in some:
                    bins.add(p)
                    if bins.bytes > FLUSH:
                        yield bins.batch()
                slab = {}
        bins.leave()
        yield bins.batch()

    def again(level: int):
        def run(key, table):
            bins = Bins(capacity, space, key[0].as_py(), level)
            table = table.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            for p in zip(*(table.column(c).to_pylist() for c in _ARROW.names[:5]), strict=True):
                bins.add(p)
            bins.leave()
            return pa.Table.from_batches([bins.batch()])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    level = common.stash(rows.mapInArrow(first, _SCHEMA), "packed")
    done, n = [level.where("closed")], 1
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN)
        left = level.where("not closed").withColumn("group", F.floor(F.col("part") / FAN))
        level = common.stash(left.groupBy("group").applyInArrow(again(n), _SCHEMA), "packed")
        done.append(level.where("closed"))
        n += 1
    out = level.where("not closed")
    for d in done:
        out = out.unionAll(d)
    return out.drop("closed", "part")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, doc_ids, ids``: the packed sequences themselves."""
    part = F.struct("offset", "doc_id", "ids")
    rows = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    join = lambda a, x: F.concat(a, x["ids"])
    return rows.select(
        "sequence_id",
        "length",
        F.col("parts.doc_id").alias("doc_ids"),
        F.aggregate("parts", F.lit(b"").cast("binary"), join).alias("ids"),
    )


def digest(docs: DataFrame, **how) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pack(docs, **how).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
