"""Evaluation measures and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators import evaluation, fusion
from linkweave.plans import derive as D
from linkweave.plans.catalog.registration import registrar, rounded
from linkweave.plans.oracle import with_ctes

ENTRIES: dict = {}
entry = registrar(ENTRIES)

_BIN = " + ".join(f"CAST(probability >= {i * 0.1!r} AS INTEGER)" for i in range(1, 10))
_ECE = f"""SELECT sum(abs(pos - mass)) / sum(n) AS v FROM (SELECT {_BIN} AS bin, count(*) AS n,
    sum(truth) AS pos, sum(probability) AS mass FROM eval_cases GROUP BY 1)"""
_AUC = """SELECT (sum(CASE WHEN truth = 1 THEN r ELSE 0 END) - p * (p + 1) / 2.0) / (p * q) AS v
    FROM (SELECT truth, rank() OVER (ORDER BY probability)
        + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r,
        sum(truth) OVER () AS p, sum(1 - truth) OVER () AS q FROM eval_cases) GROUP BY p, q"""
_FAR = """SELECT 100.0 * count(*) FILTER (WHERE truth = 0 AND decision = 'HIGH_CONFIDENCE_LINK')
    / count(*) FILTER (WHERE truth = 0) AS v FROM cases_decided"""
_RECALL = """SELECT 100.0 * sum(truth) / least(10, (SELECT sum(truth) FROM eval_cases)) AS v
    FROM (SELECT truth FROM eval_cases ORDER BY probability DESC, case_id LIMIT 10)"""


@entry(
    "brier_score",
    with_ctes(
        "eval_cases",
        "SELECT round(avg((probability - truth) * (probability - truth)), 6) AS brier_score"
        " FROM eval_cases",
    ),
)
def brier_score(spark, d):
    return evaluation.brier(D.eval_cases(spark, d)).select(rounded("brier_score"))


@entry(
    "calibration_bins",
    with_ctes(
        "eval_cases",
        f"""SELECT {_BIN} AS bin, count(*) AS n, CAST(sum(truth) AS BIGINT) AS positives,
             round(sum(probability), 6) AS mass FROM eval_cases GROUP BY 1""",
    ),
)
def calibration_bins(spark, d):
    return evaluation.calibration_bins(D.eval_cases(spark, d)).withColumn(
        "mass", F.round("mass", 6)
    )


@entry(
    "expected_calibration_error",
    with_ctes("eval_cases", f"SELECT round(v, 6) AS expected_calibration_error FROM ({_ECE})"),
)
def expected_calibration_error(spark, d):
    return evaluation.calibration_error(D.eval_cases(spark, d)).select(
        rounded("expected_calibration_error")
    )


@entry(
    "false_attribution_rate",
    with_ctes(
        "cases_decided", f"SELECT round(v, 6) AS false_attribution_rate_percent FROM ({_FAR})"
    ),
)
def false_attribution_rate(spark, d):
    return evaluation.false_attribution(D.eval_cases(spark, d)).select(
        rounded("false_attribution_rate_percent")
    )


@entry(
    "recall_at_ten",
    with_ctes("eval_cases", f"SELECT round(v, 6) AS recall_at_k_percent FROM ({_RECALL})"),
)
def recall_at_ten(spark, d):
    return evaluation.recall_at(D.eval_cases(spark, d), 10).select(rounded("recall_at_k_percent"))


@entry("roc_auc", with_ctes("eval_cases", f"SELECT round(v, 6) AS roc_auc FROM ({_AUC})"))
def roc_auc(spark, d):
    return evaluation.roc_auc(D.eval_cases(spark, d)).select(rounded("roc_auc"))


@entry(
    "train_test_split",
    with_ctes(
        "eval_cases",
        """SELECT case_id, CASE WHEN row_number() OVER (ORDER BY case_id) - 1
             < (SELECT count(*) FROM eval_cases) // 2 THEN 'train' ELSE 'test' END AS part
           FROM eval_cases""",
    ),
)
def train_test_split(spark, d):
    return evaluation.split_halves(D.eval_cases(spark, d)).select("case_id", "part")


@entry(
    "evaluation_report",
    with_ctes(
        "cases_decided",
        f"""SELECT round(b, 4) AS brier_score, round(e, 4) AS expected_calibration_error,
             round(f, 2) AS false_attribution_rate_percent, round(r, 2) AS recall_at_k_percent,
             round(a, 4) AS roc_auc, round(s, 2) AS short_text_abstention_rate_percent,
             n AS total_cases, e < 0.15 AS ece_target_passed, f = 0 AS far_target_passed,
             r = 100 AS recall_target_passed, a > 0.9 AS roc_auc_target_passed
           FROM (SELECT (SELECT avg((probability - truth) * (probability - truth)) FROM eval_cases)
               AS b, (SELECT v FROM ({_ECE})) AS e, (SELECT v FROM ({_FAR})) AS f,
               (SELECT v FROM ({_RECALL})) AS r, (SELECT v FROM ({_AUC})) AS a,
               (SELECT 100.0 * count(*) FILTER (WHERE abstained) / count(*)
                 FILTER (WHERE short_text) FROM eval_cases) AS s,
               (SELECT count(*) FROM eval_cases) AS n)""",
    ),
)
def evaluation_report(spark, d):
    return evaluation.report(D.eval_cases(spark, d))


@entry(
    "isotonic_calibration",
    with_ctes(
        "eval_cases",
        """, train AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY case_id) AS rn
               FROM eval_cases) WHERE rn <= (SELECT count(*) FROM eval_cases) // 2),
           pts AS (SELECT final_llr AS x, sum(truth) AS s, count(*) AS w,
               row_number() OVER (ORDER BY final_llr) AS i FROM train GROUP BY final_llr),
           cum AS (SELECT i, x, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw,
               s, w FROM pts),
           blocks AS (SELECT a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS v
               FROM cum a JOIN cum b ON b.i >= a.i),
           low AS (SELECT lo, p.i, min(v) AS v FROM blocks JOIN pts p ON p.i >= lo AND p.i <= hi
               GROUP BY lo, p.i),
           fit AS (SELECT p.i, any_value(p.x) AS x, max(v) AS y FROM pts p JOIN low
               ON low.i = p.i GROUP BY p.i),
           pred AS (SELECT c.case_id, c.final_llr,
               (SELECT max(x) FROM fit WHERE x <= c.final_llr) AS x0,
               (SELECT min(x) FROM fit WHERE x >= c.final_llr) AS x1 FROM eval_cases c)
           SELECT case_id, round(CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL OR x0 = x1 THEN a.y
               ELSE a.y + (b.y - a.y) * (final_llr - x0) / (x1 - x0) END, 6) AS calibrated_prob
           FROM pred LEFT JOIN fit a ON a.x = x0 LEFT JOIN fit b ON b.x = x1""",
    ),
)
def isotonic_calibration(spark, d):
    """Curve fitted on the first half of the cases, applied to all of them."""
    cases = D.eval_cases(spark, d)
    train = evaluation.split_halves(cases).where("part = 'train'")
    model = evaluation.fit_isotonic(train)
    scored = evaluation.isotonic_calibrator(model)(cases)
    return scored.select("case_id", F.round("posterior_probability", 6).alias("calibrated_prob"))


@entry(
    "custom_discount_and_caps",
    with_ctes(
        "effective",
        """SELECT link_id, round(sum(least(f, 4.0)), 6) AS total_capped_llr FROM (
             SELECT link_id, family, sum(CASE WHEN rn = 1 THEN eff ELSE 0.5 * eff END) AS f
             FROM (SELECT *, row_number() OVER (PARTITION BY link_id, family, dependence_group
               ORDER BY eff DESC, id) AS rn FROM effective WHERE counts)
             GROUP BY link_id, family) GROUP BY link_id""",
    ),
)
def custom_discount_and_caps(spark, d):
    """Fusion with another discount and one cap for every family."""
    caps = {f: 4.0 for f in fusion.fixed.FAMILIES}
    out = fusion.fuse(D.evidence_items(spark, d), discount=0.5, caps=caps)
    return out.where(F.size("families_present") > 0).select("link_id", rounded("total_capped_llr"))
