"""Scores, probabilities and the labels that follow from them.

Each rule is written once as SQL text over column names or expressions; the functions
hand it out as a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave import fixed

EFFECTIVE_LLR = (
    "CASE WHEN abstain OR is_contradiction THEN 0D ELSE "
    "coalesce(llr, ln(greatest(m_i, 1e-12D) / greatest(u_i, 1e-12D))) "
    "* greatest(0D, least(1D, source_reliability * credibility_multiplier)) END"
)


def effective_llr() -> Column:
    """Log-likelihood ratio of an evidence row after its reliability discount.

    Abstained and contradicting rows weigh nothing here.
    """
    return F.expr(EFFECTIVE_LLR)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def posterior_sql(llr: str, prior_log_odds: float = fixed.PRIOR_LOG_ODDS) -> str:
    return f"1D / (1D + exp(-greatest(-50D, least(50D, ({llr}) + {float(prior_log_odds)}D))))"


def posterior(llr: str, prior_log_odds: float = fixed.PRIOR_LOG_ODDS) -> Column:
    """Sigmoid of the score plus the prior log odds, argument kept within +-50."""
    return F.expr(posterior_sql(llr, prior_log_odds))


def decision(penalty: str, final_llr: str, probability: str) -> Column:
    """Rejected on any penalty or a negative score, else graded by probability."""
    return F.expr(
        f"CASE WHEN {penalty} > 0 OR {final_llr} < 0 THEN '{fixed.REJECTED}' "
        f"WHEN {probability} >= {fixed.HIGH_PROBABILITY} THEN '{fixed.HIGH}' "
        f"WHEN {probability} >= {fixed.LOW_PROBABILITY} THEN '{fixed.LOW}' "
        f"ELSE '{fixed.INSUFFICIENT}' END"
    )


def confidence_tier(probability: str) -> Column:
    return F.expr(
        f"CASE WHEN {probability} >= 0.85 THEN 'High Confidence' "
        f"WHEN {probability} >= 0.60 THEN 'Medium Confidence' "
        f"WHEN {probability} >= 0.35 THEN 'Low Confidence' ELSE 'Insufficient Evidence' END"
    )


def _case(value: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {value} {arms} ELSE {default} END"


def decision_status(decision_col: str) -> Column:
    return F.expr(_case(decision_col, fixed.DECISION_STATUS, "'PROPOSED'"))


def review_status(verb: str) -> Column:
    return F.expr(_case(verb, fixed.REVIEW_STATUS, "NULL"))


def family_cap(caps: dict[str, float], unknown: float | None, family: str = "family") -> Column:
    default = "NULL" if unknown is None else repr(float(unknown))
    table = {k: float(v) for k, v in caps.items()}
    return F.expr(f"CAST({_case(family, table, default)} AS DOUBLE)")


def short_text_score(similarity: str) -> Column:
    """Log-odds style score of a short-text similarity, within -5..10."""
    odds = f"log2(({similarity} + 0.01D) / (1.01D - {similarity}))"
    return F.expr(f"greatest(-5D, least(10D, round({odds} * 2.5D, 2)))")


def distance_probability(distance: str) -> Column:
    return F.expr(f"round(1D / (1D + exp(-2.5D + 15D * {distance})), 4)")


def places_sql(value: str, places: int) -> str:
    """Text with a fixed number of places, rounded from the exact binary value as C's printf does.

    ``format_string`` rounds the shortest decimal text instead: 3.105, in binary a little less,
    would become 3.11. ``format_number`` errs only on 0.00005, hence the first arm.
    """
    unit = f"1E-{places}D"
    value = f"CASE WHEN abs({value}) = 5E-{places + 1}D THEN signum({value}) * {unit} ELSE {value} END"
    return f"format_number({value}, '0.{'0' * places}')"


def round_even(value: str, places: int) -> Column:
    """Rounding of a binary figure with ties to even, as the published scores use."""
    scale = f"{10 ** places}D"
    return F.expr(f"rint(({value}) * {scale}) / {scale}")
