"""Product codes of vectors by Lloyd's rounds on two trees.

Components become integers, floor(scale * x), and vectors are cut into ``PARTS`` equal
parts; each part position has a codebook that starts with the parts of the smallest ids.
Vectors are kept in blocks of ``BLOCK`` rows. For each position a block holds a tree over
its parts: halves at the median of the widest component, with the box and the cached sum
of every node. A round builds a small tree over the entries and walks both together: the
least and greatest distance between two boxes prune entry nodes, and a single entry is
also pruned when the difference of its distance to that of the nearest candidate cannot
be negative anywhere in the box. A node left with one entry is assigned as a whole by its
cached sum; the parts of leaves with several candidates are compared as integers. So each
assignment is exact, ties included.

Scale: blocks with their trees are written once, where the table is read; every round reads them and returns sums
per (position, entry), added up in the tasks, so a round moves a few thousand numbers
whatever the table's size. Only the codebooks, sixteen entries for each vector length,
are on the driver. The error per label is summed before anything is joined back; the
labels' sums are broadcast up to ``LABELS`` rows and joined with salted keys beyond.

Values: distances beyond 62 bits are computed with Python's integers instead, so vectors of
any float components take part (of doubles, those below 2^1011); an error beyond a long is
given as the largest long.

Nulls, ties: vectors that are null or hold null or non-finite components are dropped. Rows
with equal ids count each, ordered by vector; null ids come last. Fewer than sixteen
vectors give as many entries. Vectors of another length have codebooks of their own, which
``codebooks_sha256`` shows; a length that is no multiple of the parts is filled up with
zeros. Null labels are one label. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import common

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a block of vectors of up to 64 components; longer vectors have fewer.
BLOCK = 4096
LEAF = 16
#: Components from here on would leave the doubles when scaled.
ENDLESS = float(1 << 1011)
#: Most labels whose sums are broadcast.
LABELS = 65_536
SALT = 64
_LIMB = 30
_LONGEST = (1 << 63) - 1


def kept(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, label`` of the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < ENDLESS)
    return vectors.where(F.col("embedding").isNotNull()).where(
        F.forall("embedding", lambda x: F.coalesce(fine(x), F.lit(False)))
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"), "label")


def as_integers(x: np.ndarray, wide: bool) -> np.ndarray:
    """Whole floats as 64-bit integers, or as Python's integers."""
    if not wide:
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x) if x.size else x.astype(object)


def scaled(x: np.ndarray) -> np.ndarray:
    """Whole floats floor(SCALE * x) of rows, filled up to a multiple of the parts."""
    out = np.floor(x * SCALE)
    return np.pad(out, ((0, 0), (0, -x.shape[1] % PARTS)))


def _edges(n: int) -> list[np.ndarray]:
    """First rows of the nodes of each level of a tree over n rows, and n."""
    depth = max(0, int(np.floor(np.log2(max(1, n) / LEAF))))
    return [n * np.arange((1 << k) + 1) // (1 << k) for k in range(depth + 1)]


def part_tree(points: np.ndarray) -> dict:
    """The tree over the rows of ``points`` (whole floats): order, and boxes by level."""
    n = len(points)
    order, edges = np.arange(n), _edges(n)
    for edge in edges[:-1]:
        own = points[order]
        span = np.maximum.reduceat(own, edge[:-1]) - np.minimum.reduceat(own, edge[:-1])
        node = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        widest = span.argmax(1)[node] if span.shape[1] else np.zeros(n, np.int64)
        value = own[np.arange(n), widest] if span.shape[1] else np.zeros(n)
        order = order[np.lexsort((value, node))]
    own = points[order]
    boxes = [(np.minimum.reduceat(own, e[:-1]), np.maximum.reduceat(own, e[:-1])) for e in edges]
    return {"order": order.astype(np.int32), "points": own, "boxes": boxes}


def with_sums(tree: dict, wide: bool) -> dict:
    """The tree in integers, with the cached sums of its nodes."""
    points = as_integers(tree["points"], wide)
    sums = [np.add.reduceat(points, e[:-1]) for e in _edges(len(points))]
    boxes = [tuple(as_integers(x, wide) for x in b) for b in tree["boxes"]]
    return {"order": tree["order"], "points": points, "boxes": boxes, "sums": sums}


def entry_tree(book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lo, hi, child`` of the nodes over the entries; child is (left, right) or (-1, entry)."""
    lo, hi, child = [], [], []

    def build(ids: np.ndarray) -> int:
        at = len(lo)
        own = book[ids]
        lo.append(own.min(0))
        hi.append(own.max(0))
        child.append((-1, int(ids[0])))
        if len(ids) > 1:
            widest = int((hi[at] - lo[at]).argmax()) if book.shape[1] else 0
            value = own[:, widest].tolist() if book.shape[1] else [0] * len(ids)
            ids = ids[sorted(range(len(ids)), key=value.__getitem__)]
            child[at] = (build(ids[: len(ids) // 2]), build(ids[len(ids) // 2 :]))
        return at

    build(np.arange(len(book)))
    return np.array(lo), np.array(hi), np.array(child)


def _least(values: np.ndarray, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n nodes, the least of its pairs' values and a pair that has it."""
    first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
    least = np.minimum.reduceat(values, first)
    at = np.repeat(least, np.diff(np.append(first, len(nodes)))) == values
    one = np.zeros(n, np.int64)
    one[nodes[at][::-1]] = np.flatnonzero(at)[::-1]
    out = np.zeros(n, values.dtype)
    out[nodes[first]] = least
    return out, one


def assign(tree: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``counts, sums, labels``: rows and sums of each entry; the entry of each row in tree order."""
    n, k, m = len(tree["points"]), len(book), book.shape[1]
    counts, sums = np.zeros(k, np.int64), np.zeros((k, m), book.dtype)
    labels = np.zeros(n, np.int64)
    edges = _edges(n)
    lo_e, hi_e, child = entry_tree(book)
    leaf = child[:, 0] < 0
    square = (book * book).sum(1)

    def prune(level: int, p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = tree["boxes"][level]
        a, b, c, d = lo[p], hi[p], lo_e[e], hi_e[e]
        gap = np.maximum(np.maximum(c - b, a - d), 0)
        reach = np.maximum(d - a, b - c)
        near, far = (gap * gap).sum(1), (reach * reach).sum(1)
        best, one = _least(far, p, len(lo))
        keep = near <= best[p]
        single = leaf[e] & leaf[e[one[p]]]
        if single.any():
            i = np.flatnonzero(single & keep)
            mine, rival = child[e[i], 1], child[e[one[p[i]]], 1]
            w = (book[mine] - book[rival]) * 2
            # the most that the rival's distance can exceed one's own inside the box
            most = np.where(w > 0, w * hi[p[i]], w * lo[p[i]]).sum(1) + square[rival] - square[mine]
            keep[i] = (mine == rival) | (most > 0) | ((most == 0) & (mine < rival))
        return p[keep], e[keep]

    def split(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = ~leaf[e]
        p = np.concatenate([p[~inner], p[inner], p[inner]])
        e = np.concatenate([e[~inner], child[e[inner], 0], child[e[inner], 1]])
        order = np.lexsort((e, p))
        return p[order], e[order]

    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = 0
    while len(p):
        p, e = prune(level, p, e)
        width = len(edges[level]) - 1
        number = np.bincount(p, minlength=width)
        sure = (number[p] == 1) & leaf[e]
        if sure.any():
            q, entry = p[sure], child[e[sure], 1]
            size = edges[level][q + 1] - edges[level][q]
            np.add.at(counts, entry, size)
            np.add.at(sums, entry, tree["sums"][level][q])
            at = np.repeat(edges[level][q] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            labels[at] = np.repeat(entry, size)
            p, e = p[~sure], e[~sure]
        if level + 1 < len(edges):
            p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
            level += 1
            p, e = split(p, e)
        elif not leaf[e].all():
            p, e = split(p, e)
        else:
            break
    if len(p):  # leaves with several candidates: integers, entries in order so the lower one stays
        edge = edges[level]
        row = np.zeros(n, bool)
        for q in np.unique(p):
            row[edge[q] : edge[q + 1]] = True
        best = np.zeros(n, book.dtype)
        seen = np.zeros(n, bool)
        entry = child[e, 1]
        for c in range(k):
            q = p[entry == c]
            if not len(q):
                continue
            size = edge[q + 1] - edge[q]
            at = np.repeat(edge[q] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            gap = tree["points"][at] - book[c]
            far = (gap * gap).sum(1)
            better = ~seen[at] | (far < best[at])
            best[at[better]], labels[at[better]] = far[better], c
            seen[at] = True
        at = np.flatnonzero(row)
        np.add.at(counts, labels[at], 1)
        np.add.at(sums, labels[at], tree["points"][at])
    return counts, sums, labels


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of vectors of one length with the trees over their parts."""

    def block(dim: int, ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        parts = scaled(x)
        width = parts.shape[1] // PARTS
        trees = [part_tree(parts[:, k * width : (k + 1) * width]) for k in range(PARTS)]
        most = float(np.abs(parts).max(initial=0))
        if most < 1 << 31:
            for t in trees:
                t["points"] = t["points"].astype(np.int32)
                t["boxes"] = [tuple(b.astype(np.int32) for b in both) for both in t["boxes"]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([dim], pa.int32()), pa.array([most], pa.float64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([labels], pa.list_(pa.string())), pa.array([pickle.dumps(trees, 5)], pa.binary()),
            ],
            names=["dim", "most", "ids", "labels", "trees"],
        )

    def run(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            column = batch.column("embedding")
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            length = np.diff(offsets)
            for dim in np.unique(length).tolist():
                rows_of = np.flatnonzero(length == dim)
                x = values[offsets[rows_of][:, None] + np.arange(dim)]
                for name, column_ in (("vec_id", 0), ("label", 1)):
                    got = batch.column(name).take(pa.array(rows_of)).to_pylist()
                    waiting.setdefault(dim, [[], [], np.zeros((0, dim))])[column_].extend(got)
                w = waiting[dim]
                w[2] = np.concatenate([w[2], x])
                n = max(1, BLOCK * 64 // max(64, dim))
                while len(w[0]) >= n:
                    yield block(dim, w[0][:n], w[1][:n], w[2][:n])
                    waiting[dim] = w = [w[0][n:], w[1][n:], w[2][n:]]
        for dim, (ids, labels, x) in waiting.items():
            if ids:
                yield block(dim, ids, labels, x)

    return rows.withColumn("label", F.col("label").cast("string")).mapInArrow(
        run, "dim int, most double, ids array<long>, labels array<string>, trees binary"
    )


def _first_books(rows: DataFrame) -> dict[int, list[list[list[int]]]]:
    """For each vector length the entries of each part position, Python's integers."""
    dim = F.size("embedding")
    order = Window.partitionBy(dim).orderBy(F.asc_nulls_last("vec_id"), "embedding")
    some = (
        rows.select("embedding", dim.alias("dim"), F.row_number().over(order).alias("at"))
        .where(F.col("at") <= ENTRIES)
        .orderBy("dim", "at")
        .collect()
    )
    out: dict = {}
    for r in some:
        x = as_integers(scaled(np.array([r["embedding"]], np.float64).reshape(1, -1)), True)[0].tolist()
        width = len(x) // PARTS
        for k, book in enumerate(out.setdefault(r["dim"], [[] for _ in range(PARTS)])):
            book.append(x[k * width : (k + 1) * width])
    return out


def _block_trees(row: dict, books: list) -> tuple[list[dict], list[np.ndarray]]:
    """The trees and codebooks of a block in the integers that its distances need."""
    most = max([row["most"], *(abs(v) for b in books for x in b for v in x)])
    wide = max(1, row["dim"] + PARTS) * (2 * int(most)) ** 2 >= 1 << 62
    trees = [with_sums(t, wide) for t in pickle.loads(row["trees"])]
    width = trees[0]["points"].shape[1]
    kind = object if wide else np.int64
    return trees, [np.array(b, kind).reshape(len(b), width) for b in books]


def _totals(blocks: DataFrame, books: dict) -> dict:
    """``(dim, part, entry, place) -> sum`` over all blocks; place -1 holds the count."""

    def run(batches):
        total: dict[tuple, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for part, (tree, book) in enumerate(zip(*_block_trees(row, books[row["dim"]]), strict=True)):
                    counts, sums, _ = assign(tree, book)
                    for entry in np.flatnonzero(counts).tolist():
                        for place, v in enumerate([counts[entry], *sums[entry]], -1):
                            key = (row["dim"], part, entry, place)
                            total[key] = total.get(key, 0) + int(v)
        out = []
        for key, v in total.items():  # limbs, so that sums of any size fit longs
            limb = 0
            while True:
                top = -(1 << 32) <= v < 1 << 32
                out.append((*key, limb, v if top else v & ((1 << _LIMB) - 1)))
                if top:
                    break
                v, limb = v >> _LIMB, limb + 1
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["dim", "part", "entry", "place", "limb", "v"]
        )

    found = (
        blocks.select("dim", "most", "trees")
        .mapInArrow(run, "dim long, part long, entry long, place long, limb long, v long")
        .groupBy("dim", "part", "entry", "place", "limb")
        .agg(F.sum("v").alias("v"))
        .collect()  # a number or two per component of the codebooks
    )
    out: dict[tuple, int] = {}
    for r in found:
        key = (r["dim"], r["part"], r["entry"], r["place"])
        out[key] = out.get(key, 0) + (r["v"] << (_LIMB * r["limb"]))
    return out


def fit(rows: DataFrame, blocks: DataFrame, rounds: int = ROUNDS) -> dict:
    """The codebooks after all rounds: ``{length: [part][entry][component]}``."""
    books = _first_books(rows)
    for _ in range(rounds):
        total = _totals(blocks, books)
        for (dim, part, entry, place), v in total.items():
            if place >= 0:
                books[dim][part][entry][place] = v // total[dim, part, entry, -1]
    return books


def codes(blocks: DataFrame, books: dict) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` of every vector."""
    sha = {
        dim: hashlib.sha256(",".join(str(v) for b in of for x in b for v in x).encode()).hexdigest()
        for dim, of in books.items()
    }

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                code, error = np.zeros((n, PARTS), np.uint8), 0
                for part, (tree, book) in enumerate(zip(*_block_trees(row, books[row["dim"]]), strict=True)):
                    _, _, labels = assign(tree, book)
                    gap = tree["points"] - book[labels]
                    own = np.zeros(n, book.dtype)
                    own[tree["order"]] = (gap * gap).sum(1)
                    error = error + own
                    code[tree["order"], part] = labels
                text = code.tobytes().hex()
                wide = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                        pa.array([text[k * wide : (k + 1) * wide] for k in range(n)], pa.string()),
                        pa.array([min(int(v), _LONGEST) for v in error], pa.int64()),
                        pa.array([sha[row["dim"]]] * n, pa.string()),
                    ],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return blocks.mapInArrow(
        run, "vec_id long, label string, code string, error long, codebooks_sha256 string"
    )


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the errors summed over equal labels."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)"))
    sums = common.stash(
        rows.groupBy("label").agg(total.cast("long").alias("label_error")).withColumnRenamed("label", "of"), "labels"
    )
    if sums.count() <= LABELS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT))
    salted = sums.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part"))
    return rows.withColumn("salt", salt).join(salted, same).drop("of", "salt", "part")


def quantise(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector."""
    rows = kept(vectors)
    blocks = common.stash(blocks_of(rows), "blocks")
    found = common.stash(codes(blocks, fit(rows, blocks, rounds)), "codes")
    return with_label_error(found).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
