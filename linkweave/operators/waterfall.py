"""The waterfall behind a link: what every family and item added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import scoring
from linkweave.operators.nesting import nest


def by_family(contributions: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """Per link and family: items, raw sum, capped contribution, cap and its flag."""
    caps = caps or fixed.FAMILY_CAPS
    cap = scoring.family_cap(caps, fixed.UNKNOWN_CAP_REPORT)
    sums = (
        contributions.where("NOT abstain AND NOT is_contradiction")
        .groupBy("link_id", "family")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.sum("raw_llr").alias("raw_llr_sum"),
            F.sum("llr_contrib").alias("capped_contribution"),
        )
        .withColumn("cap_limit", cap)
    )
    over = (F.col("raw_llr_sum") > F.col("cap_limit")) | (
        F.col("capped_contribution") > F.col("cap_limit") + 1e-9
    )
    bar = F.least(F.round("capped_contribution", 4) * 2, F.lit(20.0)).cast("int")
    return sums.withColumn("is_capped", over).select(
        "*",
        F.greatest(bar, F.lit(0)).alias("bar_length"),
        F.when(
            F.col("is_capped"), F.format_string("Cap Reached (%.1f)", "cap_limit")
        )
        .otherwise("Uncapped")
        .alias("cap_status"),
    )


def contradiction_rows(contributions: DataFrame) -> DataFrame:
    """The active contradictions of each link with their weights."""
    return contributions.where("NOT abstain AND is_contradiction").select(
        "link_id", "evidence_id", "feature_name", F.abs("llr_contrib").alias("contradiction_weight")
    )


def items_nested(contributions: DataFrame, places: int | None = 4) -> DataFrame:
    """Item arrays per link and family, in chunks; without ``places`` the figures stay whole."""
    shown = (lambda c: F.col(c)) if places is None else (lambda c: F.round(c, places).alias(c))
    rows = contributions.where("NOT abstain AND NOT is_contradiction")
    item = F.struct(
        "evidence_id",
        "feature_name",
        shown("raw_llr"),
        shown("llr_contrib"),
        "dependence_group",
    )
    return nest(rows, ["link_id", "family"], item, "evidence_id")


def link_summary(results: DataFrame, contributions: DataFrame, ends: DataFrame) -> DataFrame:
    """One record per link: the pair, the verdict and its family waterfall.

    A link has at most seven families, so their array is small by construction.
    """
    step = F.struct(
        "family",
        "item_count",
        F.round("raw_llr_sum", 4).alias("raw_llr_sum"),
        "cap_limit",
        F.round("capped_contribution", 4).alias("capped_llr_contribution"),
        "is_capped",
    )
    steps = (
        by_family(contributions)
        .groupBy("link_id")
        .agg(F.array_sort(F.collect_list(step)).alias("family_contributions"))
    )
    against = (
        contradiction_rows(contributions)
        .groupBy("link_id")
        .agg(F.count(F.lit(1)).alias("contradiction_count"))
    )
    return (
        results.join(steps, "link_id", "left")
        .join(against, "link_id", "left")
        .join(ends, "link_id", "left")
        .select(
            "link_id",
            F.col("subject_id").alias("target"),
            F.col("object_id").alias("candidate"),
            "decision",
            F.round("posterior_probability", 4).alias("posterior_probability"),
            F.round("final_llr", 4).alias("final_net_llr"),
            F.struct(
                F.lit(0.0).alias("base_prior_llr"),
                F.coalesce("family_contributions", F.array()).alias("family_contributions"),
                F.round("total_capped_llr", 4).alias("total_positive_capped_llr"),
                F.round("contradiction_penalty", 4).alias("contradiction_penalty"),
                F.coalesce("contradiction_count", F.lit(0)).alias("contradiction_count"),
            ).alias("waterfall"),
        )
    )


def bar_widths(results: DataFrame) -> DataFrame:
    """Bar width of each family on its link's scale, and of the penalty.

    The scale is the link's largest family score, never below ten; the map of
    family scores sits in the link row, so no shuffle is needed.
    """
    scale = F.greatest(F.array_max(F.map_values("family_scores")), F.lit(10.0))
    return results.withColumn("scale", scale).select(
        "link_id",
        F.explode("family_scores").alias("family", "score"),
        "scale",
        "contradiction_penalty",
        "families_present",
    ).where(F.array_contains("families_present", F.col("family"))).select(
        "link_id",
        "family",
        "score",
        "scale",
        scoring.clamp(F.col("score") / F.col("scale") * 100, 8.0, 100.0).alias("width_pct"),
        F.least(F.lit(100.0), F.col("contradiction_penalty") / 15.0 * 100).alias(
            "penalty_width_pct"
        ),
    )
