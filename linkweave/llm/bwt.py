"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller id is removed; strings are judged on the input, and never cross documents.

1. Texts are packed: compressed slices of about a megabyte, in packs of about ``PACK`` bytes.
   Every string belongs to its minimizer, the least hashed ``GRAM``-byte string inside it.
   Neighbouring strings mostly share it, so a text falls into segments of about 67 bytes,
   and equal strings of different documents always lie in segments of the same minimizer.
2. Two texts with a common string share its minimizer and the 17 bytes before it or those
   after it. Segments for which neither occurs in another document are left out. These
   33-byte strings are compared by hash, in ranges of it; each pack names one once, so a
   passage shared by a third of all documents is no hot group.
3. The segments of a minimizer meet in a bucket, equal ones as one with the smallest id and
   the packs that hold it. A minimizer with a single segment is done. The others of a bucket
   are two shards. The Burrows-Wheeler transforms of the shards are merged by refining their
   interleave symbol by symbol; the round in which two neighbours part is their common
   prefix, and the intervals whose prefix reaches ``LENGTH`` are the repeated strings. No
   suffix is sorted again. Segments at a side that very many texts share are salted over
   buckets, whose intervals meet by the hash of their string.
4. Smallest ids return to the packs, where the covered bytes are dropped.

Hashes only select candidates (40 bits and more), name segments and salted strings (64 bits).

Nulls, ties: a null text is empty; a null id neither removes nor loses anything; rows with
the same id do not remove from one another; texts shorter than ``LENGTH`` lose nothing. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common

LENGTH = 50
GRAM = 16
PACK = 1 << 25
#: Bytes before or after a minimizer that a common string shares.
SIDE = (LENGTH - GRAM + 1) // 2
#: Hashes in a range.
RANGE = 400_000
#: Bytes of text whose repeated segments make a bucket.
BUCKET = 1 << 20
#: Texts that share a side from which its segments are salted.
HOT = 50_000

_A = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(4)]


# --- minimizers --------------------------------------------------------------------------------


def segments(data: np.ndarray, offsets: np.ndarray):
    """``key, first, last, row, place``: runs of string starts with one minimizer, in text order."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    h = common._BYTE[data]
    for k in range(4):
        ahead = h[1 << k :]
        h = h[: -(1 << k)] * np.uint64(_A[k])
        h += ahead
    h = common.mix64(h)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = h >> bits
    low <<= bits
    low |= np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # starts whose string stays inside its text
    cut = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, cut, 1)
    np.add.at(mark, offsets[1:], -1)
    inside = np.cumsum(mark)[: len(place)] == 0
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[starts]
    at = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return h[at[first]], starts[first], starts[last], row[first], at[first]


def pack_values(values: np.ndarray) -> bytes:
    """Ascending 64-bit values in few bytes."""
    step = np.diff(values, prepend=values[:1] * 0)
    return zlib.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_values(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _runs(values: np.ndarray):
    """``begin, end`` of the runs of equal values."""
    if not len(values):
        return []
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True)


def sides(hashes, offsets: np.ndarray, place: np.ndarray, row: np.ndarray):
    """Hashes of the minimizers with what stands before and after them; 0 where a text ends.

    ``hashes`` is the ``span_hasher`` of the texts' bytes.
    """
    out = []
    for before, after in ((SIDE, 0), (0, SIDE)):
        a, b = place - before, place + GRAM + after
        ok = (a >= offsets[row]) & (b <= offsets[row + 1])
        h = np.zeros(len(place), np.uint64)
        h[ok] = hashes(a[ok], b[ok]) | np.uint64(1)
        out.append(h)
    return out


def packs(docs: DataFrame) -> DataFrame:
    """``pack, ids, sizes, body``: the documents in compressed slices."""

    def run(batches):
        import zstandard

        press, size = zstandard.ZstdCompressor(level=6), 0
        task = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task | size // PACK], pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")
                        ),
                        pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                        pa.array([press.compress(data.tobytes())], pa.binary()),
                    ],
                    names=["pack", "ids", "sizes", "body"],
                )
                size += len(data)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "pack long, ids array<long>, sizes array<long>, body binary"
    )


def _slices(batch):
    """``ids (nulls kept), bytes, offsets`` of the slices in a batch or table of packs."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for ids, sizes, body in zip(*(batch.column(c) for c in ("ids", "sizes", "body")), strict=True):
        data = np.frombuffer(press.decompress(body.as_py()), np.uint8)
        yield ids.values, data, np.concatenate([[0], np.cumsum(np.asarray(sizes.values, np.int64))])


def _candidates(packed: DataFrame, total: int) -> DataFrame:
    """``pack, keys, hot``: for each pack the packed side hashes that another text has too."""
    n_ranges = max(1, -(-total // (9 * RANGE)))
    bits = max(40, int(total).bit_length() + 8)
    drop = np.uint64(64 - bits)

    def emit(pack, held):
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        count = np.minimum(count, 1 << 15).astype(np.uint16)
        part = ((keys >> np.uint64(bits - 32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        cut = list(_runs(part))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[a]) for a, _ in cut], pa.int64()),
                pa.array([pack] * len(cut), pa.int64()),
                pa.array([pack_values(keys[a:b]) for a, b in cut], pa.binary()),
                pa.array([zlib.compress(count[a:b].tobytes(), 1) for a, b in cut], pa.binary()),
            ],
            names=["part", "pack", "keys", "counts"],
        )

    def scan(batches):
        now, held = None, []
        for batch in batches:
            for pack, (_, data, offsets) in zip(batch.column("pack").to_pylist(), _slices(batch), strict=True):
                if pack != now and held:
                    yield emit(now, held)
                    held = []
                now = pack
                _, _, _, row, place = segments(data, offsets)
                both = np.concatenate(sides(common.span_hasher(data), offsets, place, row))
                doc = np.concatenate([row, row])[both > 0]
                key = both[both > 0] >> drop
                if len(key):
                    one = np.lexsort((key, doc))
                    new = np.ones(len(one), bool)
                    new[1:] = (key[one][1:] != key[one][:-1]) | (doc[one][1:] != doc[one][:-1])
                    held.append(key[one][new])
        if held:
            yield emit(now, held)

    def compare(table: pa.Table) -> pa.Table:
        blobs = [unpack_values(k) for k in table.column("keys").to_pylist()]
        count = np.concatenate(
            [np.frombuffer(zlib.decompress(m), np.uint16) for m in table.column("counts").to_pylist()]
        )
        keys, source = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
        order = np.argsort(keys, kind="stable")
        keys, source, count = keys[order], source[order], count[order].astype(np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        docs = np.repeat(np.add.reduceat(count, begin), np.diff(np.append(begin, len(keys))))
        packs_of = table.column("pack").to_numpy()
        out = {"pack": [], "keys": [], "hot": []}
        for wanted, hot in (((docs > 1) & (docs < HOT), False), (docs >= HOT, True)):
            mine = source[wanted]
            back = np.argsort(mine, kind="stable")
            some, mine = keys[wanted][back], mine[back]
            for a, b in _runs(mine):
                out["pack"].append(int(packs_of[mine[a]]))
                out["keys"].append(pack_values(some[a:b]))
                out["hot"].append(hot)
        types = (pa.int64(), pa.binary(), pa.bool_())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return (
        packed.mapInArrow(scan, "part long, pack long, keys binary, counts binary")
        .groupBy("part")
        .applyInArrow(compare, "pack long, keys binary, hot boolean")
    )


# --- segments -----------------------------------------------------------------------------------


def _named(hashes, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash that names a segment: its bytes and its minimizer."""
    return common.mix64(hashes(first, last + LENGTH) ^ key)


def _cut(packed: DataFrame, candidates: DataFrame, total: int, buckets: int) -> DataFrame:
    """``bucket, salted, pack, segs, sizes, ids``: distinct segments of each pack, by bucket.

    ``segs`` holds them one after the other, ``ids`` the smallest and the largest id of each.
    A segment with a hot side is salted: dealt by its own hash. One whose other side is shared
    by fewer texts is listed with its minimizer as well.
    """
    drop = np.uint64(64 - max(40, int(total).bit_length() + 8))
    names = ["bucket", "salted", "pack", "segs", "sizes", "ids"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def told_keys(told: pa.Table, hot: bool) -> np.ndarray:
        blobs = [
            unpack_values(k)
            for k, x in zip(told.column("keys").to_pylist(), told.column("hot").to_pylist(), strict=True)
            if x == hot
        ]
        return np.unique(np.concatenate(blobs)) if blobs else np.zeros(0, np.uint64)

    def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        if not len(ordered):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
        return ordered[at] == values

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        none = pa.table([pa.nulls(0, t) for t in types], names=names)
        if not told.num_rows or not rows.num_rows:
            return none
        wanted = {hot: told_keys(told, hot) for hot in (False, True)}
        held: dict = {False: [], True: []}
        texts = []
        for ids, data, offsets in _slices(rows):
            key, first, last, row, place = segments(data, offsets)
            valid, doc = np.asarray(ids.is_valid())[row], np.asarray(ids.fill_null(0))[row]
            hashes = common.span_hasher(data)
            side = sides(hashes, offsets, place, row)
            for hot in (False, True):
                good = valid & ((side[0] > 0) & among(side[0] >> drop, wanted[hot]) | (side[1] > 0) & among(side[1] >> drop, wanted[hot]))
                if good.any():
                    a, b = first[good], last[good] + LENGTH
                    h = _named(hashes, key[good], first[good], last[good])
                    held[hot].append((h, key[good], doc[good], a, b, np.full(len(a), len(texts))))
            texts.append(data.tobytes())
        out = {n: [] for n in names}
        pack = rows.column("pack")[0].as_py()
        for hot, found in held.items():
            if not found:
                continue
            h, key, doc, a, b, where = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = common.mix64(h if hot else key) % np.uint64(buckets)
            order = np.lexsort((doc, h, bucket))
            new = np.ones(len(order), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(order)) - 1
            pick, most = order[begin], doc[order[end]]
            size = (b - a)[pick]
            for lo, hi in _runs(bucket[pick]):
                out["bucket"].append(int(bucket[pick[lo]]))
                out["salted"].append(hot)
                out["pack"].append(pack)
                mine = pick[lo:hi]
                spans = zip(where[mine].tolist(), a[mine].tolist(), b[mine].tolist(), strict=True)
                out["segs"].append(press.compress(b"".join([texts[w][i:j] for w, i, j in spans])))
                out["sizes"].append(zlib.compress(size[lo:hi].astype(np.uint16).tobytes(), 1))
                both = np.stack([doc[pick[lo:hi]], most[lo:hi]])
                out["ids"].append(zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

    return (
        packed.groupBy("pack")
        .cogroup(candidates.groupBy("pack"))
        .applyInArrow(
            cut, "bucket long, salted boolean, pack long, segs binary, sizes binary, ids binary"
        )
    )


def _gathered(table: pa.Table):
    """The distinct segments of a bucket: ``strings, hashes, keys, least, most, packs, held``.

    ``packs`` lists the packs that hold a segment, one segment after the other, ``held`` how many.
    """
    import zstandard

    press = zstandard.ZstdDecompressor()
    body, size, least, most, pack = [], [], [], [], []
    for p, segs, sizes, ids in zip(*(table.column(c).to_pylist() for c in ("pack", "segs", "sizes", "ids")), strict=True):
        body.append(np.frombuffer(press.decompress(segs), np.uint8))
        size.append(np.frombuffer(zlib.decompress(sizes), np.uint16).astype(np.int64))
        planes = np.frombuffer(zlib.decompress(ids), np.uint8).reshape(8, -1)
        both = np.ascontiguousarray(planes.T).view(np.int64).reshape(2, -1)
        least.append(both[0]), most.append(both[1])
        pack.append(np.full(len(size[-1]), p))
    body, size, least, most, pack = (np.concatenate(x) for x in (body, size, least, most, pack))
    offsets = np.concatenate([[0], np.cumsum(size)])
    # every start in a segment has the same minimizer, so the first tells it
    key, first, _, row, _ = segments(body, offsets)
    head = np.flatnonzero(np.diff(row, prepend=-1))
    key = key[head]
    h = _named(common.span_hasher(body), key, offsets[:-1], offsets[1:] - LENGTH)
    order = np.lexsort((h, key))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    begin = np.flatnonzero(new)
    pick = order[begin]
    whole = body.tobytes()
    strings = [whole[offsets[k] : offsets[k + 1]] for k in pick.tolist()]
    return (
        strings, h[pick], key[pick], np.minimum.reduceat(least[order], begin),
        np.maximum.reduceat(most[order], begin), pack[order], np.diff(np.append(begin, len(h))),
    )


# --- Burrows-Wheeler transforms -------------------------------------------------------------------


class Shard:
    """The sorted suffixes of some strings and their Burrows-Wheeler transform.

    Symbols are bytes + 1; 0 ends a string. Ends sort before all bytes, in string order.
    """

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) + 1 for s in strings], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = int(size.sum())
        text = np.zeros(n, np.uint16)
        body = np.ones(n, bool)
        ends = begin + size - 1
        body[ends] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        self.owner = np.repeat(np.arange(len(strings)), size)
        self.offset = np.arange(n) - begin[self.owner]
        # ranks of ever longer prefixes; an end has a rank of its own
        rank = text.astype(np.int64) + len(strings)
        rank[ends] = np.arange(len(strings))
        left = size[self.owner] - self.offset
        step, longest = 1, int(size.max())
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            second[left <= step] = 0
            both = rank * (n + len(strings) + 300) + second
            # only equal keys could change places, and the last round has none
            order = np.argsort(both)
            both = both[order]
            new = np.ones(n, bool)
            np.not_equal(both[1:], both[:-1], out=new[1:])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            step *= 2
            if new.all() or step >= longest:
                break
        self.order = order
        before = text[order - 1]
        before[self.offset[order] == 0] = 0
        self.symbols = before
        self.strings = len(strings)


def merge(left: Shard, right: Shard, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``from_right, prefix``: the merged order and common prefixes, up to ``depth``.

    The interleave starts as all of left, then all of right. In each round every suffix is
    moved to where its extension by the symbol before it belongs, in the order reached so
    far, so after h rounds suffixes are in the order of their first h symbols. The round in
    which a place first starts a new block bounds its common prefix with the place before.
    """
    n, ends = len(left.symbols) + len(right.symbols), left.strings + right.strings
    from_right = np.zeros(n, bool)
    from_right[len(left.symbols) :] = True
    start = np.zeros(n, bool)
    start[0] = True
    prefix = np.zeros(n, np.int32 if depth > 255 else np.uint8)
    # symbols renumbered to one byte where they fit: the sort then takes one pass
    both = np.concatenate([left.symbols, right.symbols])
    used, both = np.unique(both, return_inverse=True)
    both = both.astype(np.uint8 if len(used) <= 256 else np.uint16)
    # a symbol's block begins at the same place in every round
    first = np.concatenate([[0], np.cumsum(np.bincount(both, minlength=len(used)))[:-1]])
    place, now = np.arange(n, dtype=np.int32), np.empty(n, bool)
    jump = np.int32(len(left.symbols))
    for _ in range(depth):
        # where the symbol of a place stands: the rights before it are passed over, or lead to it
        of_right = np.cumsum(from_right.view(np.int8), dtype=np.int32)
        at = place - of_right
        at += from_right * (jump - 1 + of_right - at)
        order = np.argsort(both.take(at), kind="stable")
        moved = np.cumsum(start.view(np.int8), dtype=np.int32).take(order)
        np.not_equal(moved[1:], moved[:-1], out=now[1:])
        now[first] = True
        from_right = from_right.take(order)
        # the ends of strings: in string order, each by itself
        from_right[: left.strings] = False
        from_right[left.strings : ends] = True
        now[:ends] = True
        start |= now
        # places still inside their block share one more symbol with the place before
        prefix += ~start
    prefix[0] = 0
    return from_right, prefix


def least_ids(strings: list[bytes], ids: np.ndarray) -> np.ndarray:
    """The smallest id of a string that holds the LENGTH-byte string at each start of each string."""
    half = (len(strings) + 1) // 2
    shards = [Shard(strings[:half]), Shard(strings[half:])]
    from_right, prefix = merge(*shards, LENGTH)
    owner = np.empty(len(from_right), np.int64)
    offset = np.empty(len(from_right), np.int64)
    for side, shard, base in ((~from_right, shards[0], 0), (from_right, shards[1], half)):
        owner[side] = shard.owner[shard.order] + base
        offset[side] = shard.offset[shard.order]
    begin = np.flatnonzero(prefix < LENGTH)
    lowest = np.minimum.reduceat(ids[owner], begin)
    each = np.repeat(lowest, np.diff(np.append(begin, len(prefix))))
    starts = np.array([len(s) for s in strings]) - LENGTH + 1
    base = np.cumsum(starts) - starts
    real = offset < starts[owner]
    out = np.empty(int(starts.sum()), np.int64)
    out[base[owner[real]] + offset[real]] = each[real]
    return out


def _found(strings: list[bytes], key: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each string of the segments (in the order of their minimizer).

    ``ids, size``: one segment after the other, and how many each has. A segment whose minimizer
    no other one has holds its own smallest id, which is told once.
    """
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    several = np.flatnonzero(~(new[1:] & new[:-1]))
    size = np.ones(len(strings), np.int64)
    if not len(several):
        return least, size
    size[several] = [len(strings[k]) - LENGTH + 1 for k in several.tolist()]
    ids = np.repeat(least, size)
    met = np.zeros(len(strings), bool)
    met[several] = True
    ids[np.repeat(met, size)] = least_ids([strings[k] for k in several.tolist()], least[several])
    return ids, size


def _binaries(body: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of ``body`` as bytes, ``size`` rows together."""
    offsets = np.concatenate([[0], np.cumsum(size)]) * body.strides[0]
    return pa.Array.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]
    )


def _steps(ids: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Equal neighbours of a segment as one (first place, id) pair; how many pairs each has."""
    first = np.cumsum(size) - size
    edge = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=edge[1:])
    edge[first] = True
    at = np.flatnonzero(edge)
    n = np.add.reduceat(edge, first, dtype=np.int64)
    pairs = np.stack([at - np.repeat(first, n), ids[at]], 1).astype(np.int64)
    return _binaries(pairs, n), n


def _intervals(segs: DataFrame) -> DataFrame:
    """``pack, hash, steps``: the smallest id of every string of the segments of each pack.

    A segment that no other text shares any string with is left out.
    """

    def plain(table: pa.Table) -> pa.Table:
        strings, h, key, least, most, packs_of, held = _gathered(table)
        ids, size = _found(strings, key, least)
        steps, n = _steps(ids, size)
        # all of it first occurs in the one text that has it
        own = (least == most) & (n == 1) & (ids[np.cumsum(size) - size] == least)
        rows = np.repeat(np.arange(len(h)), held)
        told = ~own[rows]
        rows = rows[told]
        return pa.table(
            {
                "pack": packs_of[told],
                "hash": h.view(np.int64)[rows],
                "steps": steps.take(pa.array(rows)).cast(pa.binary()),
            }
        )

    columns = ["bucket", "pack", "segs", "sizes", "ids"]
    result = (
        segs.where(~F.col("salted"))
        .select(*columns)
        .groupBy("bucket")
        .applyInArrow(plain, "pack long, hash long, steps binary")
    )

    # segments with a hot side: the intervals of their buckets meet by the hash of the string
    def spread(table: pa.Table) -> pa.Table:
        strings, h, key, least, _, packs_of, held = _gathered(table)
        ids, told = _found(strings, key, least)
        size = np.array([len(s) - LENGTH + 1 for s in strings])
        # a segment that met no other has one id for all of its strings
        ids = np.repeat(ids, np.where(told == size, 1, size)[np.repeat(np.arange(len(size)), told)])
        grams = []
        for s in strings:
            at = np.arange(len(s) - LENGTH + 1)
            grams.append(common.span_hashes(np.frombuffer(s, np.uint8), at, at + LENGTH))
        held = [p.tolist() for p in np.split(packs_of, np.cumsum(held)[:-1])]
        return pa.table(
            {
                "hash": np.repeat(h.view(np.int64), size),
                "at": np.concatenate([np.arange(n) for n in size]),
                "gram": np.concatenate(grams).view(np.int64),
                "least": ids,
                # the packs stand in a segment's first row only
                "packs": pa.array(
                    [p if not k else None for p, n in zip(held, size, strict=True) for k in range(n)],
                    pa.list_(pa.int64()),
                ),
            }
        )

    def gather(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("at")
        packs_of = ordered.column("packs")[0].as_py()
        n = len(packs_of)
        (steps,), _ = _steps(ordered.column("lowest").to_numpy(), np.array([ordered.num_rows]))
        return pa.table(
            {
                "pack": pa.array(packs_of, pa.int64()),
                "hash": pa.array([ordered.column("hash")[0].as_py()] * n, pa.int64()),
                "steps": pa.array([steps.as_py()] * n, pa.binary()),
            }
        )

    salted = segs.where("salted").select(*columns)
    if salted.isEmpty():
        return result
    each = common.stash(
        salted.groupBy("bucket").applyInArrow(
            spread, "hash long, at long, gram long, least long, packs array<long>"
        ),
        "salted",
    )
    lowest = each.groupBy("gram").agg(F.min("least").alias("lowest"))
    met = (
        each.join(lowest, "gram")
        .select("hash", "at", "lowest", "packs")
        .groupBy("hash")
        .applyInArrow(gather, "pack long, hash long, steps binary")
    )
    return result.unionByName(met)


# --- texts --------------------------------------------------------------------------------------


def _drop(packed: DataFrame, intervals: DataFrame) -> DataFrame:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()), ("kept", pa.binary()),
        ]
    )

    def drop(rows: pa.Table, told: pa.Table) -> pa.Table:
        hashes = told.column("hash").to_numpy().view(np.uint64) if told.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        steps = told.column("steps").take(pa.array(order)).combine_chunks().cast(pa.large_binary())
        _, edges, body = steps.buffers() if len(steps) else (None, bytes(8), b"")
        edges = np.frombuffer(edges, np.int64)[: len(steps) + 1]
        n_steps = np.diff(edges) // 16
        first_step = np.cumsum(n_steps) - n_steps
        pairs = np.frombuffer(body or b"", np.int64)[: edges[-1] // 8].reshape(-1, 2)
        least = np.minimum.reduceat(pairs[:, 1], first_step) if len(pairs) else pairs[:, 1]
        out = []
        for ids, data, offsets in _slices(rows):
            key, first, last, row, _ = segments(data, offsets)
            h = _named(common.span_hasher(data), key, first, last)
            at, to = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            hit = to > at
            valid, doc = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            mark = np.zeros(len(data) + 1, np.int32)
            # a segment may be told twice, with its minimizer and salted
            seg = np.flatnonzero(hit & valid[row])
            times = (to - at)[seg]
            told_at = np.repeat(at[seg] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            seg = np.repeat(seg, times)
            lower = least[told_at] < doc[row[seg]] if len(seg) else np.zeros(0, bool)
            seg, told_at = seg[lower], told_at[lower]
            whole = n_steps[told_at] == 1
            np.add.at(mark, first[seg[whole]], 1)
            np.add.at(mark, last[seg[whole]] + LENGTH, -1)
            seg, told_at = seg[~whole], told_at[~whole]
            times = n_steps[told_at]
            own = np.repeat(first_step[told_at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            ends = np.append(pairs[1:, 0], 0)[own] if len(own) else own
            ends[np.cumsum(times) - 1] = last[seg] - first[seg] + 1
            seg = np.repeat(seg, times)
            lower = pairs[own, 1] < doc[row[seg]]
            seg, own, ends = seg[lower], own[lower], ends[lower]
            np.add.at(mark, first[seg] + pairs[own, 0], 1)
            np.add.at(mark, first[seg] + ends - 1 + LENGTH, -1)
            gone = np.cumsum(mark[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            edge[starts] = gone[starts]
            total = np.concatenate([[0], np.cumsum(gone)])
            spans = np.concatenate([[0], np.cumsum(edge)])
            removed, runs = total[offsets[1:]] - total[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]
            sha, kept = [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                body = data[a:b]
                if removed[k]:
                    kept.append(body[~gone[a:b]].tobytes())
                    sha.append(hashlib.sha256(kept[-1]).hexdigest())
                else:
                    kept.append(None)
                    sha.append(hashlib.sha256(body).hexdigest())
            out.append(
                pa.table(
                    [
                        ids, pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs),
                        pa.array(sha, pa.string()), pa.array(kept, pa.binary()),
                    ],
                    schema=schema,
                )
            )
        return pa.concat_tables(out) if out else schema.empty_table()

    return (
        packed.groupBy("pack")
        .cogroup(intervals.groupBy("pack"))
        .applyInArrow(
            drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        )
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``.

    ``kept`` is the remaining text as bytes where something was removed, else null.
    """
    packed = common.stash(packs(docs), "packs")
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    total = packed.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    segs = common.stash(_cut(packed, _candidates(packed, total), total, buckets), "segments")
    return _drop(packed, _intervals(segs))
