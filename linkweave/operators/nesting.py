"""Nested records without unbounded groups.

A record such as "a link with all its items" is one row only while it is small. Each
key is therefore split into as many chunks as its row count asks for; nearly every key
has a single chunk, and a key with a billion rows becomes many rows instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1000


def nest(
    rows: DataFrame,
    keys: list[str],
    item: Column,
    order_key: str,
    name: str = "items",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``keys, chunk, <name>``: arrays of ``item`` sorted by ``order_key``.

    Chunks hold about ``chunk_rows`` items each. Nothing is dropped.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_chunks"))
    chunk = F.pmod(F.xxhash64(F.col(order_key)), F.col("_chunks")).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("chunk", chunk)
        .groupBy(*keys, "chunk")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(order_key).alias("k"), item.alias("v")))),
                lambda x: x["v"],
            ).alias(name)
        )
    )
