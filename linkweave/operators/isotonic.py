"""Isotonic calibration: pool-adjacent-violators as a tree of mergeable solutions.

Pooling is associative over neighbouring stretches: the solution of a stretch is a list of
blocks (from, to, sum, weight) with rising means, and pooling the blocks of two neighbours
gives the solution of both. So each range partition of the scores is solved by itself and
``FAN`` neighbours are merged at a time until one list is left: the curve of all rows, none
of them sampled. Sums and weights are whole numbers, so the pooling is exact.

A task reads one range partition of distinct scores, or the blocks of ``FAN`` stretches;
pooling leaves few blocks of many 0/1 outcomes. Curves of up to ``POINTS`` points are sent
to the tasks whole; longer ones are joined by stretch, of which at most ``POINTS`` limits
are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut_lineage

FAN = 8
POINTS = 65_536
_BLOCK = "part long, lo double, hi double, s long, w long"


def pooled(lo: list, hi: list, s: list, w: list) -> tuple[list, list, list, list]:
    """Blocks in order of score, neighbours whose means do not rise made one."""
    a, b, c, d = [], [], [], []
    for x, y, t, n in zip(lo, hi, s, w):
        while c and c[-1] * n >= t * d[-1]:
            x, t, n = a.pop(), t + c.pop(), n + d.pop()
            b.pop()
        a.append(x)
        b.append(y)
        c.append(t)
        d.append(n)
    return a, b, c, d


def _frame(part: int, blocks: tuple[list, list, list, list]) -> pd.DataFrame:
    lo, hi, s, w = blocks
    out = pd.DataFrame({"part": np.full(len(lo), part, np.int64), "lo": lo, "hi": hi, "s": s, "w": w})
    return out.astype({"lo": "float64", "hi": "float64", "s": "int64", "w": "int64"})


def fit(cases: DataFrame, score: str, truth: str) -> DataFrame:
    """``lo, hi, s, w``: the blocks of the curve over all rows with a score and an outcome."""
    n = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (
        cases.select(F.col(score).cast("double").alias("lo"), F.col(truth).cast("long").alias("t"))
        .where("lo IS NOT NULL AND NOT isnan(lo) AND t IS NOT NULL")
        .groupBy("lo")
        .agg(F.sum("t").alias("s"), F.count(F.lit(1)).alias("w"))
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = ([], [], [], [])
        for pdf in batches:  # sorted: what is pooled so far stays in front
            x = pdf["lo"].tolist()
            new = (x, x, pdf["s"].tolist(), pdf["w"].tolist())
            blocks = pooled(*(old + more for old, more in zip(blocks, new)))
        yield _frame(TaskContext.get().partitionId(), blocks)

    def merge(key, pdf):
        pdf = pdf.sort_values("lo")
        return _frame(int(key[0]), pooled(*(pdf[c].tolist() for c in ("lo", "hi", "s", "w"))))

    stretches = points.repartitionByRange(n, "lo").sortWithinPartitions("lo")
    blocks = cut_lineage(stretches.mapInPandas(solve, _BLOCK))
    while n > 1:
        n = -(-n // FAN)
        blocks = cut_lineage(
            blocks.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(merge, _BLOCK)
        )
    return blocks.drop("part")


def points_of(curve: DataFrame) -> DataFrame:
    """``x, y``: both ends of every block, between which the curve is straight."""
    ends = F.array_distinct(F.array("lo", "hi"))
    return curve.select(F.explode(ends).alias("x"), (F.col("s") / F.col("w")).alias("y"))


def predict(rows: DataFrame, curve: DataFrame, score: str, name: str) -> DataFrame:
    """``rows`` with the curve's value at ``score``; beyond its ends the end's value."""
    points = cut_lineage(points_of(curve))
    total = points.count()
    if total <= POINTS:
        found = points.orderBy("x").toPandas()
        xs, ys = found["x"].to_numpy(), found["y"].to_numpy()

        @F.pandas_udf("double")
        def value(x: pd.Series) -> pd.Series:
            return pd.Series(np.where(x.isna(), np.nan, np.interp(x.to_numpy(float), xs, ys))).replace({np.nan: None})

        return rows.withColumn(name, value(F.col(score).cast("double")))
    # points by stretch: limits are every k-th point in order
    every = -(-total // POINTS)
    limits = np.sort(
        points.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).select("x").toPandas()["x"].to_numpy()
    )

    @F.pandas_udf("long")
    def stretch(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, x.to_numpy(float), "right"))

    own = points.withColumn("stretch", stretch("x"))
    listed = own.groupBy("stretch").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))
    edges = listed.select("stretch", F.col("p")[0].alias("first"), F.element_at("p", -1).alias("last")).toPandas()
    before, after = {}, {}
    for k in range(len(limits) + 1):
        before[k], after[k] = None, None
    seen = edges.sort_values("stretch")
    for (a, prev), (b, nxt) in zip(
        list(zip(seen["stretch"], seen["last"]))[:-1], list(zip(seen["stretch"], seen["first"]))[1:]
    ):
        for k in range(a + 1, b + 1):
            before[k] = prev
        for k in range(a, b):
            after[k] = nxt
    spark = rows.sparkSession
    around = spark.createDataFrame(
        [(k, before[k], after[k]) for k in before],
        "stretch long, before struct<x:double,y:double>, after struct<x:double,y:double>",
    )
    table = around.join(listed, "stretch", "left").select(
        "stretch",
        F.array_compact(F.concat(F.array("before"), F.coalesce("p", F.array()), F.array("after"))).alias("p"),
    )
    x = F.col("_x")
    low = F.try_element_at(F.filter("p", lambda q: q["x"] <= x), F.lit(-1))
    high = F.get(F.filter("p", lambda q: q["x"] >= x), 0)
    part = (x - low["x"]) / (high["x"] - low["x"])
    at = (
        F.when(low.isNull(), high["y"])
        .when(high.isNull() | (low["x"] == high["x"]), low["y"])
        .otherwise(low["y"] + (high["y"] - low["y"]) * part)
    )
    keyed = rows.withColumn("_x", F.col(score).cast("double")).withColumn("stretch_", stretch("_x"))
    table = table.withColumnRenamed("stretch", "stretch_")
    return keyed.join(table, "stretch_", "left").withColumn(name, F.when(x.isNotNull(), at)).drop("_x", "stretch_", "p")
