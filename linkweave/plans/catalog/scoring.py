"""Evidence rows, fusion, waterfall, rescoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.functions import scoring
from linkweave.operators import evidence, fusion, waterfall
from linkweave.plans import derive as D
from linkweave.plans.catalog.registration import registrar
from linkweave.plans.catalog.registration import rounded as r6
from linkweave.plans.oracle import with_ctes

ENTRIES: dict = {}
entry = registrar(ENTRIES)


@entry(
    "prior_table",
    with_ctes(
        "priors evidence_rows",
        """SELECT p.feature_name, prior_family, prior_group, prior_m, prior_u, prior_weight,
             count(r.id) AS uses FROM priors p LEFT JOIN evidence_rows r
             ON p.feature_name = r.feature_name GROUP BY ALL""",
    ),
)
def prior_table(spark, d):
    """Priors beside the number of evidence rows that use each."""
    uses = D.evidence_rows(spark, d).groupBy("feature_name").agg(F.count("id").alias("uses"))
    return (
        evidence.prior_table(spark)
        .join(uses, "feature_name", "left")
        .withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))
    )


@entry(
    "evidence_rows_normalised",
    with_ctes(
        "items",
        """SELECT link_id, id, feature_name, family, dependence_group, m_i, u_i, llr,
             is_contradiction, contradiction_weight, abstain, round(source_reliability, 6)
             AS source_reliability, round(credibility_multiplier, 6) AS credibility_multiplier
           FROM items""",
    ),
)
def evidence_rows_normalised(spark, d):
    return D.evidence_items(spark, d).select(
        "link_id", "id", "feature_name", "family", "dependence_group", "m_i", "u_i", "llr",
        "is_contradiction", "contradiction_weight", "abstain", r6("source_reliability"),
        r6("credibility_multiplier"),
    )


@entry(
    "evidence_rows_factory_defaults",
    with_ctes(
        "items",
        """SELECT feature_name, family, CASE WHEN feature_name = 'unlisted_feature'
             THEN 'unlisted_feature' ELSE dependence_group END AS dependence_group,
             CASE WHEN feature_name = 'unlisted_feature' THEN 0.8::DOUBLE ELSE m_i END AS m_i,
             CASE WHEN feature_name = 'unlisted_feature' THEN 0.05::DOUBLE ELSE u_i END AS u_i,
             count(*) AS n_rows FROM items GROUP BY ALL""",
    ),
)
def evidence_rows_factory_defaults(spark, d):
    rows = evidence.normalise_rows(D.evidence_rows(spark, d), defaults="factory")
    return rows.groupBy("feature_name", "family", "dependence_group", "m_i", "u_i").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


_LABELS = ["Exact Identity", "Financial", "infrastructure", "CONTENT_NLP", "Content / NLP", "Stylometry"]


@entry(
    "legacy_rows_adapted",
    """SELECT CAST(l_orderkey AS VARCHAR) AS link_id, l_returnflag AS feature_name,
         CASE l_partkey % 6 WHEN 0 THEN 'EXACT_IDENTITY' WHEN 1 THEN 'FINANCIAL'
           WHEN 2 THEN 'INFRASTRUCTURE' WHEN 5 THEN 'STYLOMETRY' ELSE 'CONTENT_NLP' END AS family,
         l_linenumber = 7 AS is_contradiction,
         CASE WHEN l_linenumber <> 7 THEN 0.0 WHEN l_suppkey % 4 = 0 THEN 15.0
           WHEN l_suppkey % 4 = 1 THEN 20.0 WHEN l_suppkey % 4 = 2 THEN 8.0 ELSE 10.0 END::DOUBLE
           AS contradiction_weight, count(*) AS n_rows
       FROM lineitem GROUP BY ALL""",
)
def legacy_rows_adapted(spark, d):
    names = F.array(
        *[F.lit(x) for x in
          ("Temporal Impossibility", "PGP Key Identity Conflict", "Wallet Conflict", "Other")]
    )
    rows = D.table(spark, d, "lineitem").select(
        D.text("l_orderkey").alias("link_id"),
        D.item_id().alias("evidence_id"),
        F.get(F.array(*[F.lit(x) for x in _LABELS]), F.pmod("l_partkey", F.lit(6)).cast("int"))
        .alias("family"),
        F.col("l_returnflag").alias("value"),
        F.lit(0.9).alias("m_prob"),
        F.lit(0.01).alias("u_prob"),
        D.text("l_suppkey").alias("dependence_group"),
        (F.col("l_linenumber") == 7).alias("is_contradiction"),
        F.get(names, F.pmod("l_suppkey", F.lit(4)).cast("int")).alias("contradiction_type"),
    )
    return (
        evidence.adapt_legacy_rows(rows)
        .groupBy("link_id", "feature_name", "family", "is_contradiction", "contradiction_weight")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@entry(
    "effective_llr_by_feature",
    with_ctes(
        "effective",
        """SELECT feature_name, family, count(*) FILTER (WHERE counts) AS counted,
             round(sum(eff), 4) AS eff_sum, round(max(eff), 6) AS eff_max,
             round(min(eff), 6) AS eff_min FROM effective GROUP BY feature_name, family""",
    ),
)
def effective_llr_by_feature(spark, d):
    items = D.evidence_items(spark, d).withColumn("eff", scoring.effective_llr())
    return items.groupBy("feature_name", "family").agg(
        F.count_if(~F.col("abstain") & ~F.col("is_contradiction")).alias("counted"),
        F.round(F.sum("eff"), 4).alias("eff_sum"),
        F.round(F.max("eff"), 6).alias("eff_max"),
        F.round(F.min("eff"), 6).alias("eff_min"),
    )


@entry(
    "group_leaders",
    with_ctes(
        "discounted",
        """SELECT link_id, family, dependence_group, max(id) FILTER (WHERE rn = 1) AS lead_id,
             round(sum(part), 6) AS g_score FROM discounted GROUP BY ALL""",
    ),
)
def group_leaders(spark, d):
    return fusion.group_leaders(D.evidence_items(spark, d)).withColumn(
        "g_score", F.round("g_score", 6)
    )


@entry(
    "fused_scores",
    with_ctes(
        "fused",
        """SELECT link_id, round(raw_llr, 6) AS raw_llr,
             round(total_capped_llr, 6) AS total_capped_llr,
             round(contradiction_penalty, 6) AS contradiction_penalty,
             round(total_capped_llr - contradiction_penalty, 6) AS final_llr,
             CAST(independent_families AS BIGINT) AS independent_families, families_present,
             CAST(abstained_items AS BIGINT) AS abstained_items,
             CAST(total_items AS BIGINT) AS total_items FROM fused""",
    ),
)
def fused_scores(spark, d):
    return fusion.fuse(D.evidence_items(spark, d)).select(
        "link_id", r6("raw_llr"), r6("total_capped_llr"), r6("contradiction_penalty"),
        r6("final_llr"), "independent_families",
        F.array_join("families_present", ",").alias("families_present"),
        "abstained_items", "total_items",
    )


@entry(
    "family_scores",
    with_ctes(
        "family_sums",
        """SELECT link_id, family, round(score, 6) AS score, f_sum > cap AS is_capped
           FROM family_sums""",
    ),
)
def family_scores(spark, d):
    """Capped score of each family present in a link."""
    fused = fusion.fuse(D.evidence_items(spark, d))
    long = fused.select(
        "link_id", "families_present", F.explode("family_scores").alias("family", "score")
    ).where(F.array_contains("families_present", F.col("family")))
    cap = scoring.family_cap(fusion.fixed.FAMILY_CAPS, None)
    return long.select("link_id", "family", r6("score"), (F.col("score") >= cap).alias("is_capped"))


@entry(
    "contribution_waterfall_items",
    with_ctes(
        "contribs",
        """SELECT link_id, evidence_id, feature_name, family, dependence_group,
             round(raw_llr, 6) AS raw_llr, round(llr_contrib, 6) AS llr_contrib, is_discounted,
             is_capped, is_contradiction, abstain FROM contribs""",
    ),
)
def contribution_waterfall_items(spark, d):
    return fusion.contributions(D.evidence_items(spark, d)).select(
        "link_id", "evidence_id", "feature_name", "family", "dependence_group", r6("raw_llr"),
        r6("llr_contrib"), "is_discounted", "is_capped", "is_contradiction", "abstain",
    )


@entry(
    "link_evaluation",
    with_ctes(
        "evaluated",
        """SELECT link_id, round(final_llr, 6) AS final_llr,
             round(posterior_probability, 6) AS posterior_probability, decision,
             CASE decision WHEN 'CONTRADICTION_REJECTED' THEN printf(
               'Rejected: contradiction penalty %.2f, final score %.2f.',
               contradiction_penalty::DOUBLE, final_llr)
             WHEN 'HIGH_CONFIDENCE_LINK' THEN printf('High confidence: probability %.4f, '
               || 'final score %.2f, %d independent families.', posterior_probability, final_llr,
               independent_families)
             WHEN 'LOW_CONFIDENCE_LINK' THEN printf('Low confidence: probability %.4f, '
               || 'final score %.2f; needs review.', posterior_probability, final_llr)
             ELSE printf('Insufficient evidence: probability %.4f, final score %.2f.',
               posterior_probability, final_llr) END AS explanation FROM evaluated""",
    ),
)
def link_evaluation(spark, d):
    return fusion.evaluate(D.evidence_items(spark, d)).select(
        "link_id", r6("final_llr"), r6("posterior_probability"), "decision", "explanation"
    )


# --- outward record, batch scoring, waterfall ----------------------------------------

_FAM4 = ", ".join(
    f"'{f}=' || printf('%.4f', coalesce(max(score) FILTER (WHERE family = '{f}'), 0.0))"
    for f in sorted(fusion.fixed.FAMILIES)
)


@entry(
    "public_scores",
    with_ctes(
        "evaluated family_sums",
        f"""SELECT v.link_id, round(v.raw_llr, 4) AS raw_llr,
             round(v.total_capped_llr, 4) AS total_capped_llr,
             round(v.contradiction_penalty, 4)::DOUBLE AS contradiction_penalty,
             round(v.final_llr, 4) AS final_llr,
             round(v.posterior_probability, 4) AS calibrated_prob,
             CASE WHEN round(v.posterior_probability, 4) >= 0.85 THEN 'High Confidence'
               WHEN round(v.posterior_probability, 4) >= 0.6 THEN 'Medium Confidence'
               WHEN round(v.posterior_probability, 4) >= 0.35 THEN 'Low Confidence'
               ELSE 'Insufficient Evidence' END AS confidence_tier, v.decision,
             CAST(v.independent_families AS BIGINT) AS independent_family_count,
             CAST(v.abstained_items AS BIGINT) AS abstained_items_count, f.family_scores
           FROM evaluated v JOIN (SELECT e.link_id, concat_ws(',', {_FAM4}) AS family_scores
             FROM (SELECT DISTINCT link_id FROM items) e LEFT JOIN family_sums s
             ON e.link_id = s.link_id GROUP BY e.link_id) f ON v.link_id = f.link_id""",
    ),
)
def public_scores(spark, d):
    out = fusion.public_scores(fusion.evaluate(D.evidence_items(spark, d)))
    shown = scoring.places_sql("e.value", 4)
    flat = F.array_join(
        F.expr(f"transform(array_sort(map_entries(family_scores)), e -> concat(e.key, '=', {shown}))"),
        ",",
    )
    return out.select(
        "link_id", "raw_llr", "total_capped_llr", "contradiction_penalty", "final_llr",
        "calibrated_prob", "confidence_tier", "decision", "independent_family_count",
        "abstained_items_count", flat.alias("family_scores"),
    )


@entry(
    "public_contributions_nested",
    with_ctes(
        "contribs",
        """SELECT link_id, 0 AS chunk, count(*) AS n_items,
             string_agg(evidence_id, '|' ORDER BY evidence_id) AS evidence_ids,
             round(sum(round(llr_contrib, 4)), 4) AS contribution_sum
           FROM contribs GROUP BY link_id""",
    ),
)
def public_contributions_nested(spark, d):
    """Item arrays of the outward record, chunked per link."""
    from linkweave.operators.nesting import nest

    rows = fusion.contributions(D.evidence_items(spark, d))
    item = F.struct("evidence_id", F.round("llr_contrib", 4).alias("llr_contrib"))
    nested = nest(rows, ["link_id"], item, "evidence_id")
    total = F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["llr_contrib"])
    return nested.select(
        "link_id",
        "chunk",
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.transform("items", lambda x: x["evidence_id"]), "|").alias("evidence_ids"),
        F.round(total, 4).alias("contribution_sum"),
    )


@entry(
    "batch_link_scores",
    with_ctes(
        "evaluated_batch",
        """SELECT link_id, round(final_llr, 4) AS raw_log_lr,
             round(posterior_probability, 4) AS calibrated_prob,
             CASE decision WHEN 'HIGH_CONFIDENCE_LINK' THEN 'ACCEPTED'
               WHEN 'LOW_CONFIDENCE_LINK' THEN 'PROPOSED' ELSE 'INSUFFICIENT' END AS status
           FROM evaluated_batch""",
    ),
)
def batch_link_scores(spark, d):
    rows = evidence.rows_from_links(D.link_list(spark, d))
    return fusion.evaluate(rows).select(
        "link_id",
        F.round("final_llr", 4).alias("raw_log_lr"),
        F.round("posterior_probability", 4).alias("calibrated_prob"),
        scoring.decision_status("decision").alias("status"),
    )


@entry(
    "batch_link_items",
    with_ctes(
        "contribs_batch",
        """SELECT 'H' || link_id AS hypothesis_id, evidence_id, family, round(raw_llr, 4) AS raw_llr,
             round(llr_contrib, 4) AS contribution, is_contradiction FROM contribs_batch""",
    ),
)
def batch_link_items(spark, d):
    """Contributions written back beside the evidence of each link."""
    rows = evidence.rows_from_links(D.link_list(spark, d))
    return D.stored_items(fusion.contributions(rows)).select(
        "hypothesis_id", "evidence_id", "family", "raw_llr", "contribution", "is_contradiction"
    )


_BY_FAMILY = """SELECT c.link_id, c.family, count(*) AS item_count, sum(raw_llr) AS raw_llr_sum,
    sum(llr_contrib) AS contrib, max(cap) AS cap_limit FROM contribs c
    JOIN caps k ON c.family = k.family WHERE NOT abstain AND NOT is_contradiction
    GROUP BY c.link_id, c.family"""


@entry(
    "waterfall_by_family",
    with_ctes(
        "contribs caps",
        f"""SELECT link_id, family, item_count, round(raw_llr_sum, 6) AS raw_llr_sum,
             round(contrib, 6) AS capped_contribution, cap_limit, raw_llr_sum > cap_limit AS is_capped,
             greatest(0, CAST(floor(least(round(contrib, 4) * 2, 20)) AS INTEGER)) AS bar_length,
             CASE WHEN raw_llr_sum > cap_limit THEN printf('Cap Reached (%.1f)', cap_limit)
               ELSE 'Uncapped' END AS cap_status FROM ({_BY_FAMILY})""",
    ),
)
def waterfall_by_family(spark, d):
    out = waterfall.by_family(fusion.contributions(D.evidence_items(spark, d)))
    return out.withColumn("raw_llr_sum", F.round("raw_llr_sum", 6)).withColumn(
        "capped_contribution", F.round("capped_contribution", 6)
    )


@entry(
    "waterfall_items_nested",
    with_ctes(
        "contribs",
        """SELECT link_id, family, 0 AS chunk, count(*) AS n_items,
             string_agg(evidence_id || ':' || printf('%.4f', llr_contrib), '|'
               ORDER BY evidence_id) AS item_list FROM contribs
           WHERE NOT abstain AND NOT is_contradiction GROUP BY link_id, family""",
    ),
)
def waterfall_items_nested(spark, d):
    # rounded once, by the text: a figure rounded before may end on the other side of a tie
    nested = waterfall.items_nested(fusion.contributions(D.evidence_items(spark, d)), None)
    shown = scoring.places_sql("x.llr_contrib", 4)
    line = F.expr(f"transform(items, x -> concat(x.evidence_id, ':', {shown}))")
    return nested.select(
        "link_id", "family", "chunk", F.size("items").cast("long").alias("n_items"),
        F.array_join(line, "|").alias("item_list"),
    )


@entry(
    "waterfall_contradictions",
    with_ctes(
        "contribs",
        """SELECT link_id, evidence_id, feature_name, abs(llr_contrib) AS contradiction_weight
           FROM contribs WHERE is_contradiction AND NOT abstain""",
    ),
)
def waterfall_contradictions(spark, d):
    return waterfall.contradiction_rows(fusion.contributions(D.evidence_items(spark, d)))


@entry(
    "link_summary",
    with_ctes(
        "evaluated contribs caps ends",
        f"""SELECT v.link_id, e.subject_id AS target, e.object_id AS candidate, v.decision,
             round(v.posterior_probability, 4) AS posterior_probability,
             round(v.final_llr, 4) AS final_net_llr, coalesce(f.steps, '') AS steps,
             coalesce(x.n, 0) AS contradiction_count
           FROM evaluated v JOIN ends e ON v.link_id = e.link_id
           LEFT JOIN (SELECT link_id, string_agg(family || ':' || CAST(item_count AS VARCHAR) || ':'
               || printf('%.4f', contrib), '|' ORDER BY family) AS steps
             FROM ({_BY_FAMILY}) GROUP BY link_id) f ON v.link_id = f.link_id
           LEFT JOIN (SELECT link_id, count(*) AS n FROM contribs WHERE is_contradiction
             AND NOT abstain GROUP BY link_id) x ON v.link_id = x.link_id""",
    ),
)
def link_summary(spark, d):
    items = D.evidence_items(spark, d)
    out = waterfall.link_summary(
        fusion.evaluate(items), fusion.contributions(items), D.link_ends(spark, d)
    )
    shown = scoring.places_sql("s.capped_llr_contribution", 4)
    steps = F.expr(
        "transform(waterfall.family_contributions, s -> "
        f"concat_ws(':', s.family, CAST(s.item_count AS STRING), {shown}))"
    )
    return out.select(
        "link_id", "target", "candidate", "decision", "posterior_probability", "final_net_llr",
        F.array_join(steps, "|").alias("steps"),
        F.col("waterfall.contradiction_count").cast("long").alias("contradiction_count"),
    )


@entry(
    "waterfall_bar_widths",
    with_ctes(
        "family_sums fused",
        """SELECT f.link_id, f.family, round(f.score, 6) AS score, round(m.scale, 6) AS scale,
             round(greatest(8.0, least(100.0, f.score / m.scale * 100)), 6) AS width_pct,
             round(least(100.0, u.contradiction_penalty / 15.0 * 100), 6) AS penalty_width_pct
           FROM family_sums f JOIN (SELECT link_id, greatest(max(score), 10.0) AS scale
             FROM family_sums GROUP BY link_id) m ON f.link_id = m.link_id
           JOIN fused u ON f.link_id = u.link_id""",
    ),
)
def waterfall_bar_widths(spark, d):
    return waterfall.bar_widths(fusion.fuse(D.evidence_items(spark, d))).select(
        "link_id", "family", r6("score"), r6("scale"), r6("width_pct"), r6("penalty_width_pct")
    )


@entry(
    "stored_family_totals",
    with_ctes(
        "hyp_items caps",
        """SELECT h.hypothesis_id, h.family, round(sum(contribution), 4) AS total,
             round_even(least(round(sum(contribution), 4), max(cap)), 3) AS capped_total FROM hyp_items h
           JOIN caps c ON h.family = c.family WHERE NOT is_contradiction GROUP BY ALL""",
    ),
)
def stored_family_totals(spark, d):
    from linkweave.operators import reads

    return reads.family_totals(D.hypothesis_evidence(spark, d))
