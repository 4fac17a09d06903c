"""Alignment of two tokenizations of the same texts by pointer jumping.

Each text is encoded by tokenizer A (byte-level, with a space put before the text) and B
(pieces, which put that space themselves). Every token points to the farthest-right token
of the other side that overlaps it, that is the one which holds its last byte; an A token
whose end is also an end of B is terminal and points to itself. Doubling the pointers
(``p = p[p]``, all tokens of a slab of texts at once) converges in logarithmically many
steps to the terminal token of each component: the label of its group. Groups never cross
texts, since both sides end with the text.

Counts: overlapping pairs of tokens are links; one link lies between two neighbouring ends
of either side. Links are counted per pair of ids inside the tasks and summed over the
corpus. The most frequent pairs, at most ``FREQUENT``, are broadcast and looked up where
the texts are; the links of all other pairs are joined with their counts by pair, which
are rare and therefore no hot keys. The best count of each B id, one row per id of the
vocabulary, is part of the table of counts.

Scale: texts are encoded once and the ids written; nothing but id pairs and per-text sums
is shuffled. Working arrays hold one slab of texts (or one longer text); passes over the
ids take a quarter of a slab at a time, and freed memory goes back to the system.

Nulls, ties: null and empty texts, and texts whose A or B bytes differ from the text with
its space (such as texts that hold U+2581), have no tokens: zeros and an empty digest.
Pairs that share the highest count of their B id are all best. Null ids and repeated rows
count as rows of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common, tokens

#: Bytes of text whose working arrays are held, chunks remembered, bytes of a batch of rows.
SLAB = 2 << 20
REMEMBERED = 100_000
BATCH = "8m"
#: Most pairs that are broadcast: 24 bytes each.
FREQUENT = 131_072
_TOKENS = (
    "row long, doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, "
    "n_groups long, groups_sha256 string"
)
_FACTS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups_sha256 string, rare array<struct<pair:long,n:long>>"
)


def byte_table(path: str) -> list[bytes]:
    """The bytes of each A id: characters of the byte-level alphabet stand for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    alphabet = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}
    t = tokens.loaded("byte", path)
    entries = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        plain = all(c in alphabet for c in entry)
        out[i] = bytes(alphabet[c] for c in entry) if plain else entry.encode()
    return out


def piece_table(path: str) -> list[bytes]:
    """The bytes of each B id."""
    sp = tokens.loaded("piece", path)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    return [
        bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(names)
    ]


_TABLES: dict = {}


def _table(build, path: str) -> tuple[list[bytes], np.ndarray]:
    if (build, path) not in _TABLES:
        found = build(path)
        _TABLES[build, path] = found, np.array([len(x) for x in found], np.int64)
    return _TABLES[build, path]


def _joined(table: list[bytes], ids) -> bytes:
    return b"".join([table[i] for i in ids])


def pointers(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For each token, A first, the one that the farthest-right overlapping token leads to in the end."""
    n = len(a_end)
    into_b = np.searchsorted(b_end, a_end)  # the B token that holds A's last byte
    into_a = np.searchsorted(a_end, b_end)
    last = b_end[into_b] == a_end if n else np.zeros(0, bool)
    p = np.concatenate([np.where(last, np.arange(n), n + into_b), into_a])
    while True:
        q = p[p]
        if np.array_equal(p, q):
            return p
        p = q


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens each group has, in order."""
    p = pointers(a_end, b_end)
    n = len(a_end)
    terminal = p[:n] == np.arange(n)
    number = np.cumsum(terminal) - 1
    k = int(terminal.sum())
    return np.bincount(number[p[:n]], minlength=k), np.bincount(number[p[n:]], minlength=k)


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A and B token of every overlapping pair, in order."""
    ends = np.concatenate([a_end, b_end])
    ends.sort(kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)


def _joined_lists(offsets: pa.Array, texts: pa.Array, by: str) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(offsets, texts)
    return pc.binary_join(lists, pa.scalar(by, pa.large_string()))


def _strings(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The decimal ids of each group, comma-joined."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return _joined_lists(offsets, pa.array(ids).cast(pa.large_string()), ",")


def _digests(
    a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, of_group: np.ndarray
) -> list[str]:
    """The digest of each text's groups; none without tokens."""
    groups = pc.binary_join_element_wise(
        _strings(a, a_sizes), _strings(b, b_sizes), pa.scalar("|", pa.large_string())
    )
    texts = _joined_lists(pa.array(of_group, pa.int64()), groups, ";").cast(pa.large_binary())
    return [hashlib.sha256(t.as_py()).hexdigest() if len(t.as_py()) else "" for t in texts]


def _fitting(
    table: tuple[list[bytes], np.ndarray], ids: list[list[int]], chunks: list[bytes]
) -> list[bytes | None]:
    """The packed ids of each chunk, None where their bytes are not the chunk's."""
    entries, length = table
    flat = list(chain.from_iterable(ids))
    packed = tokens.packed(ids)
    if b"".join([entries[i] for i in flat]) == b"".join(chunks):  # then lengths decide
        ends = np.append(0, np.cumsum(length[np.array(flat, np.int64)]))
        at = ends[np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))]
        fits = np.diff(at) == np.fromiter(map(len, chunks), np.int64, len(chunks))
        if fits.all():
            return packed
    return [
        x if _joined(entries, i) == c else None for x, i, c in zip(packed, ids, chunks, strict=True)
    ]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``row, doc_id, a_ids, b_ids, a_sizes, b_sizes`` and more of every text; ``row`` is unique.

    The sizes say how many A and B tokens each group has, in order; ``n_groups`` and
    ``groups_sha256`` are their number and digest.
    """

    def encoder():
        """Packed A and B ids of chunks, None where their bytes are not the chunk's."""
        words = tokens.Memo(
            lambda parts: _fitting(_table(byte_table, a_path), tokens.byte_ids(a_path, parts), parts), REMEMBERED
        )

        def encode(chunks: list[bytes]) -> list[tuple[bytes, bytes] | None]:
            if not chunks:
                return []
            data = np.frombuffer(b"".join(chunks), np.uint8)
            own = np.append(0, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))))
            cuts = tokens.byte_cuts(data, own)  # A cuts at signs, too
            found, codes = words(data, cuts)
            ids, lengths = tokens.gather([x or b"" for x in found], codes)
            at = np.searchsorted(cuts, own)
            ends = (4 * np.append(0, np.cumsum(lengths))[at]).tolist()
            flat = ids.tobytes()
            missing = np.array([x is None for x in found], bool)[codes]
            odd = np.diff(np.append(0, np.cumsum(missing))[at]) > 0
            texts = [c[1:].decode("utf-8", "replace") for c in chunks]
            b = _fitting(_table(piece_table, b_path), tokens.piece_ids(b_path, texts), chunks)
            return [
                None if y is None or o else (flat[i:j], y)
                for i, j, y, o in zip(ends[:-1], ends[1:], b, odd.tolist(), strict=True)
            ]

        return encode

    def whole(text: bytes) -> tuple[bytes, bytes]:
        """Ids of a text some chunk of which differs from its bytes."""
        plain = text.decode("utf-8", "replace")
        a = _fitting(_table(byte_table, a_path), tokens.batch(tokens.loaded("byte", a_path), [plain]), [text])[0]
        b = _fitting(_table(piece_table, b_path), tokens.piece_ids(b_path, [plain[1:]]), [text])[0]
        return (b"", b"") if a is None or b is None else (a, b)

    def slab_ids(memo, data, offsets):
        """Flat A ids with their counts per text, and the same of B."""
        n, size = len(offsets) - 1, np.diff(offsets)
        # a space goes before each text that is not empty
        spaced = offsets + np.concatenate([[0], np.cumsum(size > 0)])
        own = np.insert(data, offsets[:-1][size > 0], 0x20)
        if not len(own):
            return [(np.zeros(0, np.uint32), np.zeros(n, np.int64))] * 2
        cuts = tokens.space_cuts(own, spaced)
        found, codes = memo(own, cuts)
        at = np.searchsorted(cuts, spaced)
        bad = np.array([x is None for x in found], bool)
        odd = np.flatnonzero(np.diff(np.append(0, np.cumsum(bad[codes]))[at]))
        again = {int(r): whole(own[spaced[r] : spaced[r + 1]].tobytes()) for r in odd}
        out = []
        for side in (0, 1):
            ids, lengths = tokens.gather([b"" if x is None else x[side] for x in found], codes)
            ends = np.append(0, np.cumsum(lengths))[at]
            count = np.diff(ends)
            if again:
                parts, last = [], 0
                for r, pair in sorted(again.items()):
                    parts += [ids[last : ends[r]], np.frombuffer(pair[side], "<u4")]
                    last, count[r] = ends[r + 1], len(parts[-1])
                ids = np.concatenate([*parts, ids[last:]])
            out.append((ids, count))
        return out

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))

    def run(batches):
        memo = tokens.Memo(encoder(), REMEMBERED)
        length = [_table(byte_table, a_path)[1], _table(piece_table, b_path)[1]]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = common.flat(batch.column("text"))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + SLAB, "right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                o = offsets[first : last + 1]
                (a, n_a), (b, n_b) = slab_ids(memo, data[o[0] : o[-1]], o - o[0])
                a_sizes, b_sizes = groups(np.cumsum(length[0][a]), np.cumsum(length[1][b]))
                a_ends = np.append(0, np.cumsum(n_a))
                of_group = np.searchsorted(np.append(0, np.cumsum(a_sizes)), a_ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + last - first)),
                        batch.column("doc_id").slice(first, last - first),
                        lists(a, a_ends), lists(b, np.append(0, np.cumsum(n_b))),
                        lists(a_sizes, of_group), lists(b_sizes, of_group),
                        pa.array(np.diff(of_group).astype(np.int64)),
                        pa.array(_digests(a, b, a_sizes, b_sizes, of_group), pa.string()),
                    ],
                    names=[f.split()[0] for f in _TOKENS.split(", ")],
                )
                row += last - first
                first = last
        del memo
        tokens.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENS)


def _slabs(batch: pa.RecordBatch, a_path: str, b_path: str):
    """Runs of rows of ``aligned`` with ids, ends and first tokens of both sides."""
    sides = []
    for name in ("a_ids", "b_ids"):
        column = batch.column(name)
        offsets = column.offsets.to_numpy().astype(np.int64)
        sides.append((column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]))
    first, total = 0, sides[0][1]
    while first < batch.num_rows:
        last = int(np.searchsorted(total, total[first] + (SLAB >> 2), "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        out = []
        for (ids, offsets), build, path in zip(sides, (byte_table, piece_table), (a_path, b_path), strict=True):
            o = offsets[first : last + 1]
            own = ids[o[0] : o[-1]]
            out.append((own, np.cumsum(_table(build, path)[1][own]), o - o[0]))
        yield (first, last, *out)
        first = last


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair, n, best`` over all texts; ``pair`` is ``a_id << 32 | b_id``."""

    def run(batches):
        for batch in batches:
            for _, _, (a, a_end, _), (b, b_end, _) in _slabs(batch, a_path, b_path):
                i, j = links(a_end, b_end)
                pair, n = np.unique(a[i].astype(np.int64) << 32 | b[j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
        tokens.release()

    counts = common.stash(
        rows.select("a_ids", "b_ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs"
    )
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id")
    top = counts.groupBy(b_id).agg(F.max("n").alias("top"))  # a row per id of the vocabulary
    return counts.select("pair", "n", b_id).join(F.broadcast(top), "b_id").select(
        "pair", "n", (F.col("n") == F.col("top")).alias("best")
    )


def digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Tokens, groups, links and link counts of every text, with the digest of its groups."""
    a_path = a_path or tokens.file_of("byte_bpe_50k.json")
    b_path = b_path or tokens.file_of("piece_bpe_32k.model")
    spark = docs.sparkSession
    with common.batches_of(spark, BATCH):
        rows = common.stash(aligned(docs, a_path, b_path), "aligned")
        counts = common.stash(pair_counts(rows, a_path, b_path), "counts")

    # the lowest power of two from which at most FREQUENT pairs are left
    levels = (
        counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    least, some = 64, 0
    for level, n in sorted(((r["level"], r["n"]) for r in levels), reverse=True):
        if some + n > FREQUENT:
            break
        least, some = level, some + n
    frequent = F.floor(F.log2("n")) >= least
    top = counts.where(frequent).orderBy("pair").toArrow()  # at most FREQUENT rows
    known = spark.sparkContext.broadcast(
        (top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy())
    )

    def run(batches):
        pairs, numbers, best = known.value
        for batch in batches:
            for first, last, (a, a_end, a_at), (b, b_end, b_at) in _slabs(batch, a_path, b_path):
                i, j = links(a_end, b_end)
                pair = a[i].astype(np.int64) << 32 | b[j]
                row = np.searchsorted(a_at, i, "right") - 1
                n = last - first
                if len(pairs):
                    place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                    hit = pairs[place] == pair
                else:
                    place = hit = np.zeros(len(pair), bool)
                found = row[hit], place[hit]
                total = np.zeros(n, np.int64)
                np.add.at(total, found[0], numbers[found[1]] if len(pairs) else 0)
                n_best = np.bincount(found[0][best[found[1]]] if len(pairs) else found[0], minlength=n)
                order = np.lexsort((pair[~hit], row[~hit]))
                r, p = row[~hit][order], pair[~hit][order]
                new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]))) if len(r) else np.zeros(0, np.int64)
                rare = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(r[new], np.arange(n + 1)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(p[new]), pa.array(np.diff(np.append(new, len(r))))], names=["pair", "n"]
                    ),
                )
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), pa.array(np.diff(a_at)), pa.array(np.diff(b_at)),
                        part.column("n_groups"),
                        pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                        pa.array(n_best.astype(np.int64)), pa.array(total), part.column("groups_sha256"), rare,
                    ],
                    names=[f.split()[0] for f in _NAMES],
                )

    with common.batches_of(spark, BATCH):
        facts = common.stash(rows.drop("a_sizes", "b_sizes").mapInArrow(run, _FACTS), "links")
    rest = (
        facts.select("row", F.explode("rare").alias("x"))
        .select("row", "x.pair", F.col("x.n").alias("times"))
        .join(counts.where(~frequent), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    more = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
    return facts.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256",
    )


_NAMES = (
    "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
    "groups_sha256", "rare",
)
