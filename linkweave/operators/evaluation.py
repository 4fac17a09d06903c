"""Quality of the scores: calibration, discrimination, false attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import scoring
from linkweave.operators import isotonic
from linkweave.operators.ranking import running_totals

MIN_CALIBRATION_ROWS = 5


def brier(cases: DataFrame) -> DataFrame:
    gap = F.col("probability") - F.col("truth")
    return cases.agg(F.coalesce(F.avg(gap * gap), F.lit(0.0)).alias("brier_score"))


def probability_bin(bins: int) -> Column:
    """Number of inner bin edges at or below the probability (the last bin is closed)."""
    out = F.lit(0)
    for i in range(1, bins):
        out = out + (F.col("probability") >= i * (1.0 / bins)).cast("int")
    return out


def calibration_bins(cases: DataFrame, bins: int = 10) -> DataFrame:
    return (
        cases.groupBy(probability_bin(bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("truth").alias("positives"),
            F.sum("probability").alias("mass"),
        )
    )


def calibration_error(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Share-weighted gap between hit rate and mean probability over the bins."""
    per_bin = calibration_bins(cases, bins)
    return per_bin.agg(
        F.coalesce(
            F.sum(F.abs(F.col("positives") - F.col("mass"))) / F.sum("n"), F.lit(0.0)
        ).alias("expected_calibration_error")
    )


def false_attribution(cases: DataFrame) -> DataFrame:
    negatives = F.count_if(F.col("truth") == 0)
    wrong = F.count_if((F.col("truth") == 0) & (F.col("decision") == fixed.HIGH))
    return cases.agg(
        F.when(negatives == 0, 0.0)
        .otherwise(wrong / negatives * 100.0)
        .alias("false_attribution_rate_percent")
    )


def recall_at(cases: DataFrame, k: int = 10) -> DataFrame:
    """Share of the top-k slots that true cases could fill and did."""
    top = cases.orderBy(F.desc("probability"), "case_id").limit(k)
    hits = top.agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("hits"))
    size = cases.agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("positives"),
                     F.count(F.lit(1)).alias("n"))
    value = (
        F.when(F.col("n") == 0, 0.0)
        .when(F.col("positives") == 0, 100.0)
        .otherwise(F.col("hits") / F.least(F.lit(k), F.col("positives")) * 100.0)
    )
    return _beside(hits, size).select(value.alias("recall_at_k_percent"))


def roc_auc(cases: DataFrame) -> DataFrame:
    """Share of (true, false) pairs ranked the right way round, ties half.

    Equal probabilities are merged first; the ranks come from running totals over
    range partitions, never from one sorted task.
    """
    scores = cases.groupBy("probability").agg(
        F.sum("truth").cast("long").alias("pos"),
        F.sum(1 - F.col("truth")).cast("long").alias("neg"),
    )
    ranked = running_totals(scores, ["probability"], ["neg"])
    wins = F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(38,0)"))
    pos, neg = F.sum("pos"), F.sum("neg")
    return ranked.agg(
        F.when(pos + neg == 0, 0.5)
        .when(neg == 0, 1.0)
        .when(pos == 0, 0.5)
        .otherwise(wins.cast("double") / (F.lit(2.0) * pos * neg))
        .alias("roc_auc")
    ).select(F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"))


def split_halves(cases: DataFrame, order: str = "case_id") -> DataFrame:
    """Marks the first half in order as ``train``, the rest as ``test``."""
    marked = running_totals(cases.withColumn("_one", F.lit(1)), [order], ["_one"])
    total = cases.agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))
    return _beside(marked, total).select(
        *cases.columns,
        F.when(F.col("_one_before") < F.col("_half"), "train").otherwise("test").alias("part"),
    )


def report(cases: DataFrame, k: int = 10) -> DataFrame:
    """All measures in one row, with the pass flags."""
    abstention = cases.agg(
        F.when(
            F.count_if("short_text") > 0,
            F.count_if("abstained") / F.count_if("short_text") * 100.0,
        )
        .otherwise(100.0)
        .alias("short_text_abstention_rate_percent"),
        F.count(F.lit(1)).alias("total_cases"),
    )
    out = abstention
    for part in (
        brier(cases),
        calibration_error(cases),
        false_attribution(cases),
        recall_at(cases, k),
        roc_auc(cases),
    ):
        out = _beside(out, part)
    return out.select(
        F.round("brier_score", 4).alias("brier_score"),
        F.round("expected_calibration_error", 4).alias("expected_calibration_error"),
        F.round("false_attribution_rate_percent", 2).alias("false_attribution_rate_percent"),
        F.round("recall_at_k_percent", 2).alias("recall_at_k_percent"),
        F.round("roc_auc", 4).alias("roc_auc"),
        F.round("short_text_abstention_rate_percent", 2).alias(
            "short_text_abstention_rate_percent"
        ),
        "total_cases",
        (F.col("expected_calibration_error") < 0.15).alias("ece_target_passed"),
        (F.col("false_attribution_rate_percent") == 0.0).alias("far_target_passed"),
        (F.col("recall_at_k_percent") == 100.0).alias("recall_target_passed"),
        (F.col("roc_auc") > 0.90).alias("roc_auc_target_passed"),
    )


def _beside(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row of ``left``."""
    return (
        left.withColumn("_one_key", F.lit(1))
        .join(F.broadcast(one_row.withColumn("_one_key", F.lit(1))), "_one_key")
        .drop("_one_key")
    )


def fit_isotonic(
    cases: DataFrame, score: str = "final_llr", truth: str = "truth"
) -> DataFrame | None:
    """Monotone calibration curve of all cases, or None where there are too few to fit one."""
    if cases.limit(MIN_CALIBRATION_ROWS).count() < MIN_CALIBRATION_ROWS:
        return None
    return isotonic.fit(cases, score, truth)


def isotonic_calibrator(curve: DataFrame | None):
    """Calibrator for ``fusion.evaluate``; without a curve it is the sigmoid."""

    def apply(links: DataFrame) -> DataFrame:
        if curve is None:
            return links.withColumn("posterior_probability", scoring.posterior("final_llr"))
        return isotonic.predict(links, curve, "final_llr", "_isotonic").withColumn(
            "posterior_probability", scoring.clamp(F.col("_isotonic"), 0.0, 1.0)
        ).drop("_isotonic")

    return apply
