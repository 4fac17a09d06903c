"""Activity overlap of entity pairs: smallest and mean time gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
OVERLAP_MINUTES = 60.0
CONTRADICTION_MINUTES = 30 * 24 * 60


def _stamps(activity: DataFrame) -> DataFrame:
    """Distinct instants of each entity with their weight."""
    return (
        activity.where("ts IS NOT NULL")
        .select("entity", F.unix_micros("ts").alias("t"))
        .groupBy("entity", "t")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def overlap(pairs: DataFrame, activity: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """Gap figures for pairs (``a, b``) over ``activity`` (``entity, ts``).

    All pairwise gaps are never formed. The events of the pair's quieter end become
    probes against the busier end; a probe needs only how many events lie before it, the
    sum of their times, and its two neighbours in time. Those come from running totals
    in two steps: over time buckets, and inside one bucket. So an entity that owns a
    large share of all events is spread over its buckets, and costs its own rows once,
    however many pairs it is in. Times are whole microseconds, so sums are exact.

    Unreadable times (NULL) are left out of the gaps but count as events.
    """
    stamps = _stamps(activity)
    counts = activity.groupBy("entity").agg(F.count(F.lit(1)).alias("n_all"))
    sizes = stamps.groupBy("entity").agg(
        F.sum("w").alias("n"), F.sum(F.col("t").cast("decimal(20,0)") * F.col("w")).alias("s")
    )
    known = counts.join(sizes, "entity", "left")
    end = lambda p: known.select(
        F.col("entity").alias(p), F.col("n_all").alias(f"all_{p}"),
        F.coalesce("n", F.lit(0).cast("long")).alias(f"n_{p}"),
    )
    sized = (
        pairs.join(end("a"), "a", "left")
        .join(end("b"), "b", "left")
        .selectExpr(
            "a", "b", "coalesce(all_a, 0L) AS all_a", "coalesce(all_b, 0L) AS all_b",
            "coalesce(n_a, 0L) AS n_a", "coalesce(n_b, 0L) AS n_b",
        )
    )
    live = sized.where("n_a > 0 AND n_b > 0").selectExpr(
        "a", "b", "CASE WHEN n_a <= n_b THEN a ELSE b END AS quiet",
        "CASE WHEN n_a <= n_b THEN b ELSE a END AS busy",
    )
    bucket = f"CAST(floor(t / {bucket_us}) AS BIGINT)"
    probes = live.join(
        stamps.select(F.col("entity").alias("quiet"), "t", "w"), "quiet"
    ).selectExpr("busy AS entity", "a", "b", "t", "w", f"{bucket} AS bucket")
    base = (
        stamps.join(live.select(F.col("busy").alias("entity")).distinct(), "entity", "left_semi")
        .selectExpr("entity", "t", "w", f"{bucket} AS bucket")
    )

    # figures of every bucket that has events or probes
    blocks = base.groupBy("entity", "bucket").agg(
        F.sum("w").alias("c"),
        F.sum(F.col("t").cast("decimal(20,0)") * F.col("w")).alias("ts"),
        F.min("t").alias("lo"),
        F.max("t").alias("hi"),
    )
    spots = probes.select("entity", "bucket").distinct()
    grid = blocks.join(spots, ["entity", "bucket"], "full")
    in_order = Window.partitionBy("entity").orderBy("bucket")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    after = in_order.rowsBetween(1, Window.unboundedFollowing)
    carried = grid.select(
        "entity",
        "bucket",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
        F.coalesce(F.sum("ts").over(before), F.lit(0)).alias("s0"),
        F.max("hi").over(before).alias("t_before"),
        F.min("lo").over(after).alias("t_after"),
    )

    # probes among the events of their bucket
    none = F.lit(None)
    rows = base.select(
        "entity", "bucket", "t", F.col("w").alias("bw"), none.cast("string").alias("a"),
        none.cast("string").alias("b"), none.cast("long").alias("w"),
    ).unionByName(
        probes.select(
            "entity", "bucket", "t", F.lit(0).cast("long").alias("bw"), "a", "b", "w"
        )
    )
    inside = Window.partitionBy("entity", "bucket").orderBy("t")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    on = inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    own = F.when(F.col("bw") > 0, F.col("t"))
    seen = rows.select(
        "*",
        F.sum("bw").over(upto).alias("c1"),
        F.sum(F.col("t").cast("decimal(20,0)") * F.col("bw")).over(upto).alias("s1"),
        F.max(own).over(upto).alias("p1"),
        F.min(own).over(on).alias("f1"),
    ).where("a IS NOT NULL")
    totals = sizes.select("entity", F.col("n").alias("c_all"), F.col("s").alias("s_all"))
    placed = seen.join(carried, ["entity", "bucket"]).join(totals, "entity").selectExpr(
        "a", "b", "w", "c_all",
        "CAST(t AS DECIMAL(20,0)) AS t",
        "c0 + c1 AS c",
        "CAST(s0 + s1 AS DECIMAL(38,0)) AS s",
        "s_all",
        "least(t - coalesce(p1, t_before), coalesce(f1, t_after) - t) AS gap",
    )
    gaps = placed.groupBy("a", "b").agg(
        F.min("gap").alias("min_us"),
        F.sum(
            F.expr("CAST(w * (t * (2 * c - c_all) - 2 * s + s_all) AS DECIMAL(38,0))")
        ).alias("sum_us"),
    )
    minute = "6e7D"
    return (
        sized.join(gaps, ["a", "b"], "left")
        .selectExpr(
            "a",
            "b",
            f"min_us / {minute} AS min_gap",
            f"CAST(sum_us AS DOUBLE) / (CAST(n_a AS DOUBLE) * n_b) / {minute} AS mean_gap",
            "all_a",
            "all_b",
        )
        .selectExpr(
            "a",
            "b",
            f"coalesce(min_gap <= {OVERLAP_MINUTES}, false) AS overlap_detected",
            "round(min_gap, 2) AS min_proximity_minutes",
            "round(mean_gap, 2) AS mean_proximity_minutes",
            f"coalesce(min_gap > {CONTRADICTION_MINUTES}, false) AS contradiction",
            "all_a AS num_events_a",
            "all_b AS num_events_b",
        )
    )
