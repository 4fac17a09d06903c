import math
import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import scoring
from linkweave.operators import evaluation, evidence, fusion, isotonic, waterfall
from linkweave.plans import derive

ROW = ("link_id string, id string, feature_name string, family string, dependence_group string, "
       "m_i double, u_i double, llr double, is_contradiction boolean, contradiction_weight double, "
       "abstain boolean, source_reliability double, credibility_multiplier double")


def item(link, id_, llr=None, family="CONTENT_NLP", group="g", contradiction=None, abstain=False,
         m=0.9, u=0.01, rel=1.0, cred=1.0, name="x"):
    return (link, id_, name, family, group, m, u, llr, contradiction is not None,
            float(contradiction or 0.0), abstain, rel, cred)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def reference_fusion(rows, discount=0.25):
    """Straight loop over one link's items."""
    fams, penalty = {}, 0.0
    for r in rows:
        if r[8]:
            penalty += 0.0 if r[10] else r[9]
        elif not r[10]:
            base = r[7] if r[7] is not None else math.log(max(r[5], 1e-12) / max(r[6], 1e-12))
            fams.setdefault(r[3], {}).setdefault(r[4], []).append(
                base * max(0.0, min(1.0, r[11] * r[12])))
    total = 0.0
    for fam, groups in fams.items():
        s = sum(v if i == 0 else discount * v for g in groups.values()
                for i, v in enumerate(sorted(g, reverse=True)))
        total += min(s, fixed.FAMILY_CAPS[fam])
    return total - penalty


def test_group_discount(spark):
    out = fusion.fuse(frame(spark, [item("l", "a", 4.0), item("l", "b", 2.0), item("l", "c", 1.0)]))
    row = out.first()
    assert row.final_llr == pytest.approx(4.75)
    assert row.raw_llr == pytest.approx(7.0)


def test_caps_and_penalty(spark):
    rows = [item("l", "a", 9.0, "EXACT_IDENTITY", "g1"), item("l", "b", 6.0, "EXACT_IDENTITY", "g2"),
            item("l", "c", 4.0, "FINANCIAL", "g3"), item("l", "d", contradiction=5.0)]
    row = fusion.evaluate(frame(spark, rows)).first()
    assert row.total_capped_llr == pytest.approx(14.0)
    assert row.final_llr == pytest.approx(9.0)
    assert row.decision == fixed.REJECTED
    parts = fusion.contributions(frame(spark, rows)).collect()
    assert sum(p.llr_contrib for p in parts) == pytest.approx(9.0)
    assert {p.evidence_id for p in parts if p.is_capped} == {"a", "b"}


def test_absent_families_score_zero(spark):
    row = fusion.fuse(frame(spark, [item("l", "a", 1.0)])).first()
    assert row.family_scores["FINANCIAL"] == 0.0
    assert row.independent_families == 1
    assert row.families_present == ["CONTENT_NLP"]


def test_only_abstained_and_lone_contradiction(spark):
    rows = [item("quiet", "a", 3.0, abstain=True), item("against", "b", contradiction=20.0)]
    out = {r.link_id: r for r in fusion.evaluate(frame(spark, rows)).collect()}
    assert out["quiet"].final_llr == 0.0
    assert out["quiet"].decision == fixed.INSUFFICIENT
    assert out["quiet"].abstained_items == 1
    assert out["against"].final_llr == -20.0
    assert out["against"].decision == fixed.REJECTED


def test_llr_of_default_likelihoods(spark):
    rows = [item("l", "a", m=0.99, u=0.01)]
    assert fusion.fuse(frame(spark, rows)).first().raw_llr == pytest.approx(math.log(99))


def test_random_links_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for n in range(300):
        rows.append(item(f"l{n % 40}", f"i{n}", rng.choice([None, rng.uniform(-3, 9)]),
                         rng.choice(fixed.FAMILIES), f"g{rng.randrange(3)}",
                         contradiction=rng.choice([None] * 9 + [15.0]),
                         abstain=rng.random() < 0.1, rel=rng.random(), cred=rng.random() * 1.5))
    got = {r.link_id: r.final_llr for r in fusion.fuse(frame(spark, rows)).collect()}
    sums = {r.link_id: r.s for r in fusion.contributions(frame(spark, rows)).groupBy("link_id")
            .agg(F.sum("llr_contrib").alias("s")).collect()}
    for link in got:
        want = reference_fusion([r for r in rows if r[0] == link])
        assert got[link] == pytest.approx(want, abs=1e-9)
        assert sums[link] == pytest.approx(want, abs=1e-9)


def test_worked_example(spark):
    names = ["pgp_fingerprint_exact", "btc_address_reuse", "favicon_mmh3_hash", "simhash_clone_95",
             "stylometry_burrows_delta", "handle_trigram_fuzzy"]
    raw = spark.createDataFrame([("l", str(i), n) for i, n in enumerate(names)],
                                "link_id string, id string, feature_name string")
    row = fusion.fuse(evidence.normalise_rows(raw)).first()
    assert row.final_llr <= sum(fixed.FAMILY_CAPS.values())
    assert row.independent_families == 6


def test_row_and_factory_defaults(spark):
    raw = spark.createDataFrame([("l", "e1", "nothing_known")],
                                "link_id string, id string, feature_name string")
    row = evidence.normalise_rows(raw).first()
    assert (row.m_i, row.u_i, row.dependence_group) == (0.90, 0.01, "e1")
    row = evidence.normalise_rows(raw, defaults="factory").first()
    assert (row.m_i, row.u_i, row.dependence_group) == (0.80, 0.05, "nothing_known")


def test_row_overrides(spark):
    raw = spark.createDataFrame(
        [("l", "e1", "btc_address_reuse", 2.5, None), ("l", "e2", "pgp_key_conflict", None, 7.0)],
        "link_id string, id string, feature_name string, llr double, contradiction_weight double")
    rows = {r.id: r for r in evidence.normalise_rows(raw).collect()}
    assert rows["e1"].llr == 2.5 and rows["e1"].family == "FINANCIAL"
    assert rows["e2"].is_contradiction and rows["e2"].contradiction_weight == 7.0


def test_missing_prior_file_means_defaults(spark, folder):
    empty = evidence.prior_table(spark, f"{folder}/nowhere.json")
    raw = spark.createDataFrame([("l", "e1", "btc_address_reuse")],
                                "link_id string, id string, feature_name string")
    assert evidence.normalise_rows(raw, empty).first().m_i == 0.90


def test_legacy_rows(spark):
    schema = ("link_id string, evidence_id string, family string, value string, m_prob double, "
              "u_prob double, dependence_group string, is_contradiction boolean, "
              "contradiction_type string")
    raw = spark.createDataFrame(
        [("l", "a", "Content / NLP", "v", .9, .01, "g", False, None),
         ("l", "b", "Exact Identity", "v", .9, .01, "g", True, "Wallet Conflict"),
         ("l", "c", "Exact Identity", "v", .9, .01, "g", True, "something else"),
         ("l", "d", "No Family", "v", .9, .01, "g", False, None)], schema)
    rows = {r.id: r for r in evidence.adapt_legacy_rows(raw).collect()}
    assert rows["a"].family == "CONTENT_NLP" and rows["a"].contradiction_weight == 0.0
    assert rows["b"].contradiction_weight == 8.0
    assert rows["c"].contradiction_weight == 10.0
    assert rows["d"].family is None


def test_busy_links_get_the_same_figures_by_joins(spark):
    rng = random.Random(5)
    rows = [item(f"l{n % 7 if n % 2 else 0}", f"i{n % 150}", rng.choice([None, 2.0, rng.uniform(-3, 9)]),
                 rng.choice(fixed.FAMILIES), f"g{rng.randrange(3)}",
                 contradiction=rng.choice([None] * 9 + [15.0]), abstain=rng.random() < 0.1)
            for n in range(300)]
    plan = fusion.contributions(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "RepartitionByExpression [link_id" in plan

    def figures(busy):
        out = fusion.contributions(frame(spark, rows), busy_items=busy).collect()
        return sorted((r.link_id, r.evidence_id, r.family, r.dependence_group, round(r.llr_contrib, 9),
                       round(r.raw_llr, 9), r.is_discounted, bool(r.is_capped)) for r in out)

    assert len(figures(30)) == 300
    assert figures(0) == figures(30) == figures(10_000)


def test_one_hot_link_is_not_one_row(spark):
    rows = [item("hot", f"i{n:05d}", 0.1, group=f"g{n}") for n in range(2500)]
    nested = waterfall.items_nested(fusion.contributions(frame(spark, rows))).collect()
    assert len(nested) == 3
    assert sum(len(r["items"]) for r in nested) == 2500


def test_isotonic_needs_cases(spark):
    few = spark.createDataFrame([(1.0, 1), (2.0, 0)], "final_llr double, truth int")
    assert evaluation.fit_isotonic(few) is None
    cases = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)],
                                  "final_llr double, truth int")
    model = evaluation.fit_isotonic(cases)
    probe = spark.createDataFrame([(-9.0,), (5.0,), (5.5,), (40.0,)], "final_llr double")
    out = [r.posterior_probability for r in
           evaluation.isotonic_calibrator(model)(probe).orderBy("final_llr").collect()]
    assert out == pytest.approx([0.0, 0.0, 0.5, 1.0])


@pytest.mark.parametrize("points", [65_536, 3])
def test_isotonic_equals_the_pooled_curve_of_all_rows(spark, monkeypatch, points):
    monkeypatch.setattr(isotonic, "POINTS", points)
    rng = random.Random(8)
    rows = [(round(rng.gauss(0, 2), 1), int(rng.random() < 0.5)) for _ in range(150)]
    rows += [(round(x / 10, 1), int(rng.random() < x / 100)) for x in range(100)] + [(None, 1), (2.0, None)]
    cases = spark.createDataFrame(rows, "final_llr double, truth int")
    merged = cases.dropna().groupBy("final_llr").agg(
        F.avg("truth").alias("rate"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="final_llr", labelCol="rate", weightCol="weight").fit(merged)
    probes = [(x / 7,) for x in range(-60, 90)] + [(r[0],) for r in rows if r[0] is not None]
    probe = spark.createDataFrame(probes, "final_llr double")
    want = sorted((r.final_llr, r.prediction) for r in model.transform(probe).collect())
    curve = isotonic.fit(cases, "final_llr", "truth")
    got = sorted((r.final_llr, r.y) for r in isotonic.predict(probe, curve, "final_llr", "y").collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert isotonic.fit(cases.where("false"), "final_llr", "truth").count() == 0


def test_metrics_on_edges(spark):
    schema = "case_id long, probability double, truth int, decision string, short_text boolean, " \
             "abstained boolean"
    one = spark.createDataFrame([(1, .9, 1, fixed.HIGH, False, False)], schema)
    assert evaluation.roc_auc(one).first()[0] == 1.0
    none = spark.createDataFrame([(1, .9, 0, fixed.HIGH, False, False)], schema)
    assert evaluation.roc_auc(none).first()[0] == 0.5
    assert evaluation.recall_at(none).first()[0] == 100.0
    assert evaluation.false_attribution(none).first()[0] == 100.0
    ties = spark.createDataFrame(
        [(1, .5, 1, "x", False, False), (2, .5, 0, "x", False, False),
         (3, .7, 1, "x", False, False), (4, .2, 0, "x", False, False)], schema)
    assert evaluation.roc_auc(ties).first()[0] == pytest.approx(3.5 / 4)
    row = evaluation.report(ties).first()
    assert row.short_text_abstention_rate_percent == 100.0 and row.total_cases == 4


def test_stored_score_is_the_sum_of_its_items(spark, small):
    links = derive.hypotheses(spark, small)
    sums = derive.hypothesis_evidence(spark, small).groupBy("hypothesis_id").agg(
        F.sum("contribution").alias("s"))
    worst = links.join(sums, "hypothesis_id").agg(
        F.max(F.abs(F.col("s") - F.col("raw_log_lr")))).first()[0]
    assert worst < 0.01


def test_texts_round_the_binary_value(spark):
    """3.105 is a little less in binary, 5.15625 an exact tie: rounded as printf does."""
    figures = [3.105, -4.395, 13.555, 5.15625, 0.78125, 0.00005, -0.001, 0.0, 1234567.125]
    shown = spark.createDataFrame([(x,) for x in figures], "x double").selectExpr(
        "x", f"{scoring.places_sql('x', 2)} AS two", f"{scoring.places_sql('x', 4)} AS four"
    )
    for r in shown.collect():
        assert (r.two, r.four) == (f"{r.x:.2f}", f"{r.x:.4f}")
    row = fusion.evaluate(frame(spark, [item("l", "a", 3.105)])).first()
    assert row.explanation.endswith("final score 3.10; needs review.")


def test_lone_items_keep_their_figure(spark):
    figures = [3.0 * (1 - i / 100) * (1 - j / 100) for i in range(11) for j in range(9)]
    rows = [item(f"l{i}", "a", x) for i, x in enumerate(figures)]
    got = {r.link_id: r.final_llr for r in fusion.fuse(frame(spark, rows)).collect()}
    assert got == {f"l{i}": x for i, x in enumerate(figures)}


def test_nested_items_can_stay_unrounded(spark):
    parts = fusion.contributions(frame(spark, [item("l", "a", 3.15625)]))
    assert waterfall.items_nested(parts, None).first()["items"][0].llr_contrib == 3.15625
    assert waterfall.items_nested(parts).first()["items"][0].llr_contrib == 3.1563


def test_capped_items_keep_the_last_bit(spark):
    """A family's sum is taken item by item, strongest first, as its SQL does."""
    rng = random.Random(11)
    links = {f"l{n}": sorted((rng.uniform(3, 6) for _ in range(3)), reverse=True) for n in range(200)}
    rows = [item(link, f"i{k}", x) for link, xs in links.items() for k, x in enumerate(xs)]
    got = {(r.link_id, r.evidence_id): r.llr_contrib
           for r in fusion.contributions(frame(spark, rows)).collect()}
    for link, xs in links.items():
        parts = [xs[0], 0.25 * xs[1], 0.25 * xs[2]]
        total = parts[0] + parts[1] + parts[2]
        for k, part in enumerate(parts):
            assert got[link, f"i{k}"] == part * (5.0 / total if total > 5.0 else 1.0)
