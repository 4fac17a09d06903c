"""Global order without a global task.

A running total over all rows needs every earlier row. Instead of one task holding the
whole table, rows go to range partitions of equal depth, each partition's totals are
added up over the (few) partitions, and the running total inside a partition starts
from its own offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import cut_lineage, stored


def running_totals(rows: DataFrame, order: list[str], measures: list[str]) -> DataFrame:
    """Adds ``<measure>_before``: the sum over all rows that sort earlier.

    ``order`` must identify a row. The partition number is written out with the rows,
    so both passes see the same split.
    """
    placed = cut_lineage(
        rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    # one row per shuffle partition: a few thousand at most
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .select(
            *rows.columns,
            *[
                (F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(
                    f"{m}_before"
                )
                for m in measures
            ],
        )
    )


def positions(rows: DataFrame, key: str, order: list[str], made: dict) -> DataFrame:
    """Adds ``position`` (from 1) within each ``key`` by ``order``, however many rows a key has.

    ``made`` names further columns to order by. The order is completed by the remaining
    columns, so only equal rows are interchangeable. Rows go to range partitions and are
    numbered inside them; a key's rows are consecutive, so only the first key of a partition
    goes on from earlier ones, by an offset per partition.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    # a map has no order of its own
    ties = [F.to_json(c) if "map<" in rows.schema[c].dataType.simpleString() else F.col(c) for c in rest]
    placed = stored(
        rows.withColumns(made)
        .repartitionByRange(key, *order, *ties)
        .withColumn("_part", F.spark_partition_id())
    )
    name = F.struct(F.col(key).alias("k"))
    ends = placed.groupBy("_part").agg(F.min(name).alias("_first"), F.max(name).alias("_last"))
    tails = (
        placed.select("_part", name.alias("_key"))
        .join(F.broadcast(ends), "_part")
        .groupBy("_part", "_last")
        .agg(F.count_if(F.expr("_key <=> _last")).alias("n"))
    )
    # one row per shuffle partition on either side
    carried = (
        ends.alias("e")
        .join(tails.alias("t"), F.expr("t._part < e._part AND t._last <=> e._first"), "left")
        .groupBy("e._part", "e._first")
        .agg(F.coalesce(F.sum("t.n"), F.lit(0)).alias("_carried"))
    )
    inside = Window.partitionBy("_part", key).orderBy(*order, *ties)
    return (
        placed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(carried), "_part")
        .withColumn(
            "position",
            F.col("_inside") + F.when(name.eqNullSafe(F.col("_first")), F.col("_carried")).otherwise(0),
        )
        .select(*rows.columns, F.col("position").cast("long"))
    )
