"""Fusion of evidence into one score per link, and the waterfall behind it.

Inside one dependence group the strongest item counts in full and every other one
by the discount, so a group adds ``max + d * (sum - max)``. That is an ordinary
aggregate: it combines on the map side, and a link or group that holds a large
share of all rows never has to be sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import scoring

GROUP_KEY = ["link_id", "family", "dependence_group"]


def _scored(items: DataFrame) -> DataFrame:
    return items.select(
        "*",
        scoring.effective_llr().alias("eff"),
        F.expr("NOT abstain AND NOT is_contradiction").alias("counts"),
    )


def _group_sum(discount: float) -> str:
    # in this form a lone item adds exactly its own figure
    return f"(g_max + {float(discount)}D * (g_sum - g_max))"


def fuse(
    items: DataFrame,
    discount: float = fixed.DISCOUNT,
    caps: dict[str, float] | None = None,
) -> DataFrame:
    """One row per link: family scores, penalty, final score and counters.

    Two shuffles, both after a map-side combine. The families are a closed set, so
    their sums are columns of the link row and need no level of their own.
    """
    caps = caps or fixed.FAMILY_CAPS
    families = list(fixed.FAMILIES)
    groups = (
        _scored(items)
        .groupBy(*GROUP_KEY)
        .agg(
            F.expr("sum(CASE WHEN counts THEN eff END) AS g_sum"),
            F.expr("max(CASE WHEN counts THEN eff END) AS g_max"),
            F.expr(
                "sum(CASE WHEN is_contradiction AND NOT abstain THEN contradiction_weight "
                "ELSE 0D END) AS g_penalty"
            ),
            F.expr("count_if(abstain) AS g_abstained"),
            F.expr("count(1) AS g_items"),
        )
    )
    links = groups.groupBy("link_id").agg(
        *[
            F.expr(f"sum(CASE WHEN family = '{f}' THEN {_group_sum(discount)} END) AS u_{f}")
            for f in families
        ],
        F.expr("coalesce(sum(g_sum), 0D) AS raw_llr"),
        F.expr("sum(g_penalty) AS contradiction_penalty"),
        F.expr("sum(g_abstained) AS abstained_items"),
        F.expr("sum(g_items) AS total_items"),
    )
    # least() skips NULL, so an absent family must be told apart first
    capped = {
        f: f"CASE WHEN u_{f} IS NULL THEN 0D "
        f"ELSE least(u_{f}, {float(caps.get(f, fixed.UNKNOWN_CAP_FUSION))}D) END"
        for f in families
    }
    score_map = "map(" + ", ".join(f"'{f}', {c}" for f, c in capped.items()) + ")"
    present = ", ".join(f"CASE WHEN u_{f} IS NOT NULL THEN '{f}' END" for f in sorted(families))
    total = " + ".join(f"({c})" for c in capped.values())
    positive = " + ".join(f"coalesce(CAST(u_{f} > 0 AS LONG), 0L)" for f in families)
    return links.selectExpr(
        "link_id",
        "raw_llr",
        f"{score_map} AS family_scores",
        f"{total} AS total_capped_llr",
        "contradiction_penalty",
        f"{total} - contradiction_penalty AS final_llr",
        f"{positive} AS independent_families",
        f"array_compact(array({present})) AS families_present",
        "abstained_items",
        "total_items",
    )


_PROBABILITY = scoring.places_sql("posterior_probability", 4)
_FINAL = scoring.places_sql("final_llr", 2)
_PENALTY = scoring.places_sql("contradiction_penalty", 2)

EXPLANATION = f"""CASE decision
  WHEN '{fixed.REJECTED}' THEN concat(
    'Rejected: contradiction penalty ', {_PENALTY}, ', final score ', {_FINAL}, '.')
  WHEN '{fixed.HIGH}' THEN concat('High confidence: probability ', {_PROBABILITY},
    ', final score ', {_FINAL}, ', ', independent_families, ' independent families.')
  WHEN '{fixed.LOW}' THEN concat('Low confidence: probability ', {_PROBABILITY},
    ', final score ', {_FINAL}, '; needs review.')
  ELSE concat('Insufficient evidence: probability ', {_PROBABILITY},
    ', final score ', {_FINAL}, '.') END"""


Calibrator = Callable[[DataFrame], DataFrame]


def sigmoid_calibrator(prior_log_odds: float = fixed.PRIOR_LOG_ODDS) -> Calibrator:
    """Adds ``posterior_probability`` from ``final_llr``."""
    return lambda df: df.withColumn(
        "posterior_probability", scoring.posterior("final_llr", prior_log_odds)
    )


def evaluate(
    items: DataFrame,
    calibrator: Calibrator | None = None,
    discount: float = fixed.DISCOUNT,
    caps: dict[str, float] | None = None,
) -> DataFrame:
    """Fused score, probability, decision and explanation per link."""
    scored = (calibrator or sigmoid_calibrator())(fuse(items, discount, caps))
    return scored.withColumn(
        "decision",
        scoring.decision("contradiction_penalty", "final_llr", "posterior_probability"),
    ).withColumn("explanation", F.expr(EXPLANATION))


def group_leaders(items: DataFrame, discount: float = fixed.DISCOUNT) -> DataFrame:
    """Per dependence group: its strongest item and its sum; per family: its sum."""
    return _leaders(_scored(items), discount)


def _leaders(scored: DataFrame, discount: float) -> DataFrame:
    groups = (
        scored.where("counts")
        .groupBy(*GROUP_KEY)
        .agg(
            F.expr("min(struct(-eff AS neg, id AS id)) AS lead"),
            F.expr("sum(eff) AS g_sum"),
            F.expr("max(eff) AS g_max"),
        )
    )
    return groups.selectExpr(
        *GROUP_KEY, "lead.id AS lead_id", f"{_group_sum(discount)} AS g_score"
    )


BUSY_ITEMS = 100_000


def contributions(
    items: DataFrame,
    discount: float = fixed.DISCOUNT,
    caps: dict[str, float] | None = None,
    busy_items: int = BUSY_ITEMS,
) -> DataFrame:
    """One row per item: what it adds to its link after discount and cap.

    Links of at most ``busy_items`` items meet their group and family figures in windows
    over one shuffle by link. In larger ones the figures are aggregated first and joined back
    by their own key; there the item side keeps its rows, and a key with very many items is
    split by the adaptive skew join.
    """
    caps = caps or fixed.FAMILY_CAPS
    scored = _scored(items).select(
        "link_id", "id", "feature_name", "family", "dependence_group", "eff", "counts",
        "is_contradiction", "abstain", "contradiction_weight",
        *[c for c in items.columns if c in ("metadata", "source_reliability")],
    )
    # at most one row per busy_items items
    busy = F.broadcast(
        items.groupBy("link_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > busy_items)
        .select("link_id")
    )
    in_windows = _marked_in_windows(scored.join(busy, "link_id", "left_anti"), discount, caps)
    by_joins = _marked_by_joins(scored.join(busy, "link_id", "left_semi"), discount, caps)
    kept = [c for c in items.columns if c in ("metadata", "source_reliability")]
    return in_windows.unionByName(by_joins).selectExpr(
        "link_id",
        "id AS evidence_id",
        "feature_name",
        "family",
        "dependence_group",
        "eff AS raw_llr",
        f"""CASE WHEN counts THEN eff * scale * CASE WHEN id <> lead_id THEN {float(discount)}D
              ELSE 1D END
            WHEN is_contradiction AND NOT abstain THEN -contradiction_weight
            ELSE 0D END AS llr_contrib""",
        "coalesce(counts AND id <> lead_id, false) AS is_discounted",
        "counts AND coalesce(over_cap, false) AS is_capped",
        "is_contradiction",
        "abstain",
        *kept,
    )


_SCALE = "CASE WHEN f_sum > cap THEN cap / f_sum ELSE 1D END AS scale"


def _marked_in_windows(scored: DataFrame, discount: float, caps: dict[str, float]) -> DataFrame:
    """Items with ``lead_id, scale, over_cap``; a link's items are in one task."""
    group = Window.partitionBy(*GROUP_KEY)
    ordered = group.orderBy(F.desc("counts"), "neg", "id")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # item by item, strongest first: the last bit of the sum decides ties of rounded texts
    family = (
        Window.partitionBy("link_id", "family")
        .orderBy("dependence_group", F.desc("counts"), "neg", "id")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        scored.repartition("link_id")
        .withColumn("neg", F.expr("-eff"))
        .withColumns(
            {
                "n": F.row_number().over(ordered),
                "lead_id": F.first("id").over(whole),
            }
        )
        .withColumn(
            "f_sum",
            F.sum(
                F.expr(f"CASE WHEN counts THEN eff * CASE WHEN n > 1 THEN {float(discount)}D ELSE 1D END END")
            ).over(family),
        )
        .withColumn("cap", scoring.family_cap(caps, fixed.UNKNOWN_CAP_FUSION))
        .selectExpr(*scored.columns, "lead_id", _SCALE, "f_sum > cap AS over_cap")
    )


def _marked_by_joins(scored: DataFrame, discount: float, caps: dict[str, float]) -> DataFrame:
    """Items with ``lead_id, scale, over_cap``; no task holds a whole link."""
    leaders = _leaders(scored, discount)
    families = (
        leaders.groupBy("link_id", "family")
        .agg(F.expr("sum(g_score) AS f_sum"))
        .withColumn("cap", scoring.family_cap(caps, fixed.UNKNOWN_CAP_FUSION))
        .selectExpr("link_id", "family", _SCALE, "f_sum > cap AS over_cap")
    )
    marks = leaders.join(families, ["link_id", "family"]).select(
        *GROUP_KEY, "lead_id", "scale", "over_cap"
    )
    return scored.join(marks, GROUP_KEY, "left").select(
        *scored.columns, "lead_id", "scale", "over_cap"
    )


def public_scores(results: DataFrame) -> DataFrame:
    """The outward record: every figure rounded to four places, with the tier."""
    return results.selectExpr(
        "link_id",
        "round(raw_llr, 4) AS raw_llr",
        "transform_values(family_scores, (k, v) -> round(v, 4)) AS family_scores",
        "round(total_capped_llr, 4) AS total_capped_llr",
        "round(contradiction_penalty, 4) AS contradiction_penalty",
        "round(final_llr, 4) AS final_llr",
        "round(posterior_probability, 4) AS calibrated_prob",
        "decision",
        "independent_families AS independent_family_count",
        "families_present",
        "abstained_items AS abstained_items_count",
        "explanation",
        "total_items",
    ).withColumn("confidence_tier", scoring.confidence_tier("calibrated_prob"))
