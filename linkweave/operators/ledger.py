"""State changes of the ledger: retraction, rescoring, review, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import scoring


def active_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored items whose evidence exists and is not withdrawn."""
    alive = evidence.where("retracted_at IS NULL").select("evidence_id")
    return items.join(alive, "evidence_id", "left_semi")


def first_requests(requests: DataFrame) -> DataFrame:
    """The earliest retraction request of each evidence row."""
    first = F.min(F.struct("requested_at", "request_no", "requested_by", "reason")).alias("r")
    return requests.groupBy("evidence_id").agg(first).select("evidence_id", "r.*")


def retract(
    evidence: DataFrame, requests: DataFrame, items: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stamp evidence as withdrawn; rows are kept.

    Returns the evidence table, the refused requests (unknown evidence or already
    withdrawn, including repeats in the same batch) and the accepted requests with the
    number of links citing each.
    """
    state = evidence.select("evidence_id", F.col("retracted_at").alias("_was"))
    known = first_requests(requests).join(state, "evidence_id")
    accepted = known.where("_was IS NULL").drop("_was")
    refused = (
        requests.join(
            accepted.select("evidence_id", "request_no", F.lit(True).alias("_ok")),
            ["evidence_id", "request_no"],
            "left",
        )
        .where("_ok IS NULL")
        .drop("_ok")
        .join(state.withColumn("_there", F.lit(True)), "evidence_id", "left")
        .select(
            "evidence_id",
            "request_no",
            F.when(F.col("_there").isNull(), "unknown evidence")
            .otherwise("already retracted")
            .alias("refusal"),
        )
    )
    cited = items.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("cited_by"))
    receipts = accepted.join(cited, "evidence_id", "left").withColumn(
        "cited_by", F.coalesce("cited_by", F.lit(0).cast("long"))
    )
    # evidence withdrawn before keeps its stamps, so the first request needs no look at its state
    stamps = first_requests(requests).select(
        "evidence_id",
        F.col("requested_at").alias("_at"),
        F.col("requested_by").alias("_by"),
        F.col("reason").alias("_why"),
    )
    fresh = F.col("retracted_at").isNull()
    updated = (
        evidence.join(stamps, "evidence_id", "left")
        .withColumns(
            {
                "retracted_by": F.when(fresh, F.coalesce("retracted_by", "_by")).otherwise(F.col("retracted_by")),
                "retraction_reason": F.when(fresh, F.coalesce("retraction_reason", "_why")).otherwise(
                    F.col("retraction_reason")
                ),
                "retracted_at": F.coalesce("retracted_at", "_at"),
            }
        )
        .drop("_at", "_by", "_why")
    )
    return updated, refused, receipts


def rescore(hypotheses: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links recomputed from the stored contributions that still count.

    Contributions are the stored ones: removing a group's strongest item does not
    promote the next. A proposed link that falls under the floor becomes insufficient;
    a reviewed link keeps its standing.
    """
    sums = (
        active_items(items, evidence)
        .groupBy("hypothesis_id")
        .agg(F.sum("contribution").alias("_sum"), F.count(F.lit(1)).alias("active_items"))
    )
    fresh = hypotheses.join(sums, "hypothesis_id", "left").withColumn(
        "new_log_lr", F.round(F.coalesce("_sum", F.lit(0.0)), 4)
    )
    low = (F.col("status") == "PROPOSED") & (F.col("new_log_lr") < fixed.RESCORE_FLOOR)
    return fresh.select(
        "hypothesis_id",
        F.col("raw_log_lr").alias("before_log_lr"),
        F.col("calibrated_prob").alias("before_prob"),
        F.col("new_log_lr").alias("raw_log_lr"),
        F.round(scoring.posterior("new_log_lr"), 4).alias("calibrated_prob"),
        F.coalesce("active_items", F.lit(0).cast("long")).alias("active_items"),
        F.when(low, "INSUFFICIENT").otherwise(F.col("status")).alias("status"),
    )


def rescore_affected(
    hypotheses: DataFrame, items: DataFrame, evidence: DataFrame, withdrawn: DataFrame
) -> DataFrame:
    """Rescore only the links that cite evidence withdrawn just now."""
    hit = items.join(withdrawn.select("evidence_id"), "evidence_id", "left_semi").select(
        "hypothesis_id"
    )
    touched = hypotheses.join(hit, "hypothesis_id", "left_semi")
    theirs = items.join(hit.distinct(), "hypothesis_id", "left_semi")
    return rescore(touched, theirs, evidence)


def apply_reviews(hypotheses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Links after review: the latest decision of each sets status, reviewer and time."""
    latest = F.max(F.struct("reviewed_at", "review_id", "decision", "reviewer_id")).alias("r")
    last = reviews.groupBy("hypothesis_id").agg(latest)
    return hypotheses.join(last, "hypothesis_id", "left").select(
        *[c for c in hypotheses.columns if c != "status"],
        F.coalesce(scoring.review_status("r.decision"), F.col("status")).alias("status"),
        F.col("r.reviewed_at").alias("reviewed_at"),
        F.col("r.reviewer_id").alias("reviewer_id"),
    )


def attach_identifiers(
    requests: DataFrame, cases: DataFrame, attached: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Identifiers to attach to cases -> ``(added, refused)``; refusals carry a ``reason``.

    Refused are unknown cases, blank values, and what a case has already: from ``attached``
    or from an earlier request.
    """
    rows = requests.withColumn("value", F.trim("value"))
    key = ["case_id", "id_type", "value"]
    known = cases.select("case_id", F.lit(True).alias("_case"))
    first = rows.groupBy(*key).agg(
        F.min(F.struct("created_at", "identifier_id")).alias("_first")
    )
    judged = rows.join(known, "case_id", "left").join(first, key)
    if attached is not None:
        old = attached.select(*key).distinct().withColumn("_old", F.lit(True))
        judged = judged.join(old, key, "left")
    else:
        judged = judged.withColumn("_old", F.lit(None).cast("boolean"))
    own = F.struct("created_at", "identifier_id")
    reason = (
        F.when(F.col("_case").isNull(), "unknown case")
        .when(F.coalesce("value", F.lit("")) == "", "blank value")
        .when(F.col("_old").isNotNull() | (own != F.col("_first")), "already attached")
    )
    out = judged.withColumn("reason", reason).select(*requests.columns, "reason")
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL")


def dangling(items: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Stored items that cite a missing evidence row or belong to a missing link."""
    no_evidence = items.join(evidence, "evidence_id", "left_anti").select(
        "id", "hypothesis_id", F.lit("evidence").alias("missing")
    )
    no_link = items.join(hypotheses, "hypothesis_id", "left_anti").select(
        "id", "hypothesis_id", F.lit("hypothesis").alias("missing")
    )
    return no_evidence.unionByName(no_link)


def integrity_report(items: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row of counts over the dangling items and the links."""
    bad = dangling(items, evidence, hypotheses).agg(
        F.count_if(F.col("missing") == "evidence").alias("dangling_evidence_citations"),
        F.count_if(F.col("missing") == "hypothesis").alias("orphaned_join_rows"),
        F.count_distinct(
            F.when(F.col("missing") == "evidence", F.col("hypothesis_id"))
        ).alias("affected_hypotheses"),
    )
    total = hypotheses.agg(F.count(F.lit(1)).alias("total_hypotheses"))
    one = F.lit(1).alias("_one")
    return (
        bad.withColumn("_one", one)
        .join(total.withColumn("_one", one), "_one")
        .drop("_one")
        .withColumn(
            "ok",
            (F.col("dangling_evidence_citations") == 0) & (F.col("orphaned_join_rows") == 0),
        )
    )


def doomed_ids(items: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    return dangling(items, evidence, hypotheses).select("id").distinct()


def repair(items: DataFrame, evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Stored items without the dangling ones; evidence and links stay untouched."""
    return items.join(doomed_ids(items, evidence, hypotheses), "id", "left_anti")
