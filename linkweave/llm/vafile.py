"""Exact top-k inner products with a vector-approximation file.

Each component of a vector is kept in a cell of a grid (``BITS`` bits per component, equal
widths between the component's extremes). A scan over the cells gives an upper bound of
every inner product; exact vectors are then read in the order of the bounds, a few more at
a time, until the k-th exact score exceeds every bound that is left. Ties at the k-th
score are read to the end, so the smaller id always wins.

Plan: candidates lie in hashed tiles of about ``TILE`` vectors, queries in blocks of about
``QUERIES``; each (tile, block) is one task of bounded size that returns k rows per query,
and the k best over the tiles are taken with a limit below the shuffle. Hot vectors are
spread by their ids. Only the grid, two numbers per dimension, reaches the driver.

Large components: a vector with a component of 2^31 / sqrt(length) or more after scaling, whose
scores might leave 64 bits, stays out of the grid; its scores are whole numbers of any
length, and the order is by these. A score beyond 64 bits is given as the nearest one of 64.

Nulls, ties: vectors that are null or hold null or non-finite components take no part,
nor do null ids. Vectors of different lengths are never compared. Every row is a candidate,
and a query if its id says so, also when rows repeat an id or a vector: a query's own row
is the only one left out, and each of the rows with one id has a ranking of its own. Fewer
than k candidates give all. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm import common

BITS = 4
TILE = 16_384
QUERIES = 4_096
#: Queries whose bounds are held at one time.
ROWS = 256
#: Products of components below this over the square root of the length add up below 2^62.
LARGEST = float(1 << 31)
#: The ends of 64 bits.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """``row, vec_id, x, dim, large`` of the vectors that take part; components as they are."""
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)),
    )
    bound = F.lit(LARGEST / scale) / F.sqrt(F.greatest(F.size("embedding"), F.lit(1)))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite)
        .select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").alias("x"),
            F.size("embedding").alias("dim"),
            F.exists("embedding", lambda x: F.abs(x.cast("double")) >= bound).alias("large"),
        )
    )


def grid(rows: DataFrame, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the lowest value and the cell width of every component."""
    found = (
        rows.where("NOT large").select("dim", F.posexplode("x").alias("pos", "x"))
        .groupBy("dim", "pos")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        .select("dim", "pos", *[F.floor(F.col(n).cast("double") * float(scale)).alias(n) for n in ("lo", "hi")])
        .collect()
    )
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in found}:
        some = sorted((r["pos"], r["lo"], r["hi"]) for r in found if r["dim"] == dim)
        lo = np.array([s[1] for s in some], np.int64)
        span = np.array([s[2] for s in some], np.int64) - lo + 1
        out[dim] = (lo, -(-span // (1 << BITS)))
    return out


def whole(components, scale: int) -> list[int]:
    """floor(scale * x) of each component, exact for any size."""
    return [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in map(float, components)]


def beyond(score: int) -> str | None:
    """A text that sorts like the scores above or below 64 bits; None for the others."""
    if LOW <= score <= HIGH:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(str(9 - int(c)) for c in digits)


def best_exactly(q: pd.DataFrame, c: pd.DataFrame, scale: int, k: int) -> list[tuple]:
    """``query row, query_id, vec_id, score, beyond`` rows by whole numbers of any length."""
    out = []
    vectors = [whole(x, scale) for x in c["x"]]
    ids, rows = c["vec_id"].to_list(), c["row"].to_list()
    for row, query_id, x in zip(q["row"].to_list(), q["vec_id"].to_list(), q["x"], strict=True):
        mine = whole(x, scale)
        scores = (
            (-sum(map(operator.mul, mine, v)), i) for v, i, r in zip(vectors, ids, rows, strict=True) if r != row
        )
        out += [
            (row, query_id, i, min(max(-s, LOW), HIGH), beyond(-s)) for s, i in heapq.nsmallest(k, scores)
        ]
    return out


def best_of_tile(
    query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    lo: np.ndarray, width: np.ndarray, k: int,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, ``vec_id`` and ``score`` as arrays: the k best of one tile for each query."""
    cells = ((vectors - lo) // width).astype(np.float64) if len(lo) else np.zeros((len(ids), 0))
    out = []
    for first in range(0, len(query_rows), ROWS):
        q = queries[first : first + ROWS]
        corner = (q * lo).sum(1) + np.where(q > 0, q * (width - 1), 0).sum(1)
        bound = (q * width).astype(np.float64) @ cells.T + corner[:, None]
        bound += np.abs(bound) * 1e-12  # rounding of bounds beyond 2^53
        bound[query_rows[first : first + ROWS, None] == rows[None, :]] = -np.inf
        todo, read = np.arange(len(q)), min(len(ids), 4 * k)
        while len(todo):
            b = bound[todo]
            if read < len(ids):
                at = np.argpartition(-b, read - 1, axis=1)[:, :read]
                rest = b.copy()
                np.put_along_axis(rest, at, -np.inf, axis=1)
                rest = rest.max(axis=1)
            else:
                at = np.broadcast_to(np.arange(len(ids)), (len(todo), len(ids)))
                rest = np.full(len(todo), -np.inf)
            again = []
            for j, t in enumerate(todo):
                mine = at[j][np.take(b[j], at[j]) > -np.inf]
                score = vectors[mine] @ q[t]
                order = np.lexsort((ids[mine], -score))[:k]
                sure = rest[j] == -np.inf or (len(order) == k and score[order[-1]] > rest[j])
                if not sure:
                    again.append(t)
                    continue
                out.append((np.full(len(order), first + t), ids[mine][order], score[order]))
            todo, read = np.array(again, np.int64), min(len(ids), 4 * read)
    return out


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best, smaller ids first at ties.

    Queries are the vectors whose id is divisible by ``every``.
    """
    rows = common.stash(scaled(vectors, scale), "vectors")
    total, n_queries = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)
    ).first()
    tiles, groups = max(1, -(-total // TILE)), max(1, -(-n_queries // QUERIES))
    grids = grid(rows, scale)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(tiles)).cast("int")
    group = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(groups)).cast("int")
    candidates = rows.select("*", tile.alias("tile"), numbers(groups).alias("grp"))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        "*", group.alias("grp"), numbers(tiles).alias("tile")
    )
    names = ["query", "query_id", "vec_id", "score", "beyond"]

    def scan(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        # pairs with a large end by whole numbers of any length, all others by the grid
        exact = best_exactly(q[q["large"]], c, scale, k) if q["large"].any() else []
        if c["large"].any():
            exact += best_exactly(q[~q["large"]], c[c["large"]], scale, k)
        parts = [list(zip(*exact, strict=True))] if exact else []
        q, c = q[~q["large"]], c[~c["large"]]
        if len(q) and len(c):
            lo, width = grids.get(int(key[0]), (np.zeros(0, np.int64), np.ones(0, np.int64)))
            stack = lambda x: np.floor(
                np.stack(x["x"].to_list()).astype(np.float64).reshape(len(x), len(lo)) * scale
            ).astype(np.int64)
            found = best_of_tile(
                q["row"].to_numpy(), stack(q), c["row"].to_numpy(), c["vec_id"].to_numpy(), stack(c), lo, width, k
            )
            if found:
                at, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                parts.append(
                    (q["row"].to_numpy()[at], q["vec_id"].to_numpy()[at], ids, scores, [None] * len(at))
                )
        kinds = [np.int64] * 4 + [object]
        parts = parts or [[[]] * len(names)]
        joined = [np.concatenate([np.array(x, t) for x in c]) for c, t in zip(zip(*parts, strict=True), kinds, strict=True)]
        return pd.DataFrame({n: pd.Series(x, dtype=x.dtype) for n, x in zip(names, joined, strict=True)})

    by = ["dim", "tile", "grp"]
    best = (
        queries.groupBy(*by)
        .cogroup(candidates.groupBy(*by))
        .applyInPandas(scan, "query long, query_id long, vec_id long, score long, beyond string")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
