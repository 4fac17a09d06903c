"""Exports: evidence CSV, link bundles, actor profiles, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators import graph, reads
from linkweave.session import shuffles_cleaned


def evidence_rows(detail: DataFrame) -> DataFrame:
    """Link items under the twelve export headings, missing values as their defaults."""
    defaults = {"reliability": 1.0, "raw_llr": 0.0, "contribution": 0.0, "is_contradiction": False}
    have = set(detail.columns)
    out = []
    for column, heading in fixed.EVIDENCE_EXPORT_COLUMNS:
        value = F.col(column) if column in have else F.lit(None)
        if column in defaults:
            value = F.coalesce(value, F.lit(defaults[column]))
        else:
            value = F.coalesce(value.cast("string"), F.lit(""))
        out.append(value.alias(heading))
    return detail.select(*out)


def write_evidence_csv(detail: DataFrame, path: str, compression: str = "none") -> None:
    """Writes the export; the shuffle files behind the rows go with the write."""
    out = evidence_rows(detail).write.mode("overwrite")
    with shuffles_cleaned(detail.sparkSession):
        out.option("header", True).option("compression", compression).csv(path)


def link_bundles(links: DataFrame, aliases: DataFrame, stamp: str) -> DataFrame:
    """STIX 2.1 bundles: four objects per link, and one object per alias of a subject.

    ``links`` carries ``hypothesis_id, subject_id, object_id, subject, object,
    calibrated_prob, raw_log_lr``. A link names its subject; every further name is a
    bundle of its own, once per actor, whose object has the actor's id. So records have
    one shape and size however many names an actor or links a name has.
    """
    subjects = links.select(F.col("subject_id").alias("actor_id")).distinct()
    names = aliases.groupBy("actor_id", "value").agg(F.min("alias_id").alias("alias_id"))
    own = names.join(subjects, "actor_id", "left_semi")
    conf = "CAST(coalesce(calibrated_prob, 0.5D) * 100 AS INT)"
    head = f"'2.1' AS spec_version"
    times = f"'{stamp}' AS created, '{stamp}' AS modified"
    rows = links.selectExpr(
        "*",
        "concat('threat-actor--', subject_id) AS actor_ref",
        "concat('identity--', object_id) AS target_ref",
        "array(subject) AS known_as",
    )
    objects = f"""array(
          to_json(struct('identity' AS type, {head}, 'identity--linkweave-system' AS id, {times},
            'linkweave' AS name, 'system' AS identity_class)),
          to_json(struct('threat-actor' AS type, {head}, actor_ref AS id, {times},
            subject AS name, array('cybercrime-gang', 'ransomware-operator')
            AS threat_actor_types, known_as AS aliases, {conf} AS confidence,
            'investigative_lead' AS x_assessment_type, calibrated_prob AS x_calibrated_prob,
            raw_log_lr AS x_raw_llr)),
          to_json(struct('identity' AS type, {head}, target_ref AS id, {times}, object AS name,
            'individual' AS identity_class)),
          to_json(struct('relationship' AS type, {head},
            concat('relationship--', hypothesis_id) AS id, {times},
            'attributed-to' AS relationship_type, target_ref AS source_ref,
            actor_ref AS target_ref, {conf} AS confidence)))"""
    main = rows.selectExpr("hypothesis_id AS bundle_of", f"{objects} AS objects")
    rest = own.selectExpr(
        "alias_id AS bundle_of",
        f"""array(to_json(struct('threat-actor' AS type, {head},
          concat('threat-actor--', actor_id) AS id, {times}, array(value) AS aliases)))
          AS objects""",
    )
    # every object is rendered once and nothing is parsed again; the name is quoted as JSON is
    start = "to_json(struct('bundle' AS type, concat('bundle--', bundle_of) AS id, '2.1' AS spec_version))"
    return main.unionByName(rest).selectExpr(
        "bundle_of",
        f"CASE WHEN bundle_of IS NOT NULL THEN concat(rtrim('}}', {start}), ',\"objects\":[', "
        "array_join(objects, ','), ']}') END AS bundle",
    )


def write_bundles(bundles: DataFrame, path: str) -> None:
    bundles.select(F.col("bundle").alias("value")).write.mode("overwrite").text(path)


def write_profiles(actors: DataFrame, sections: DataFrame, path: str) -> None:
    """Actor profiles as JSON lines, large sections over several lines."""
    reads.actor_profiles(actors, sections).write.mode("overwrite").json(path)


def write_graph(
    ledger: dict[str, DataFrame], hypotheses: DataFrame, root: str
) -> tuple[DataFrame, DataFrame]:
    """Replace the two graph tables and return them as read back."""
    nodes, edges = graph.project(ledger, hypotheses)
    nodes.write.mode("overwrite").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").parquet(f"{root}/edges")
    spark = hypotheses.sparkSession
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")
