"""Ingest of raw observations: legality gate, content digests, duplicates, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.operators.extract import extract_identifiers


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted observations, and the rest with the reason they are held back."""
    limit = fixed.OBSERVATION_LIMITS
    reason = f"""CASE
        WHEN NOT coalesce({_one_of('lawful_basis', fixed.LAWFUL_BASES)}, false)
          THEN 'lawful basis outside the closed list'
        WHEN NOT coalesce({_one_of('source_type', fixed.SOURCE_TYPES)}, false)
          THEN 'source type outside the closed list'
        WHEN NOT coalesce(length(raw_content) BETWEEN 1 AND {limit['raw_content']}, false)
          THEN 'content length'
        WHEN NOT coalesce(length(source_name) BETWEEN 1 AND {limit['source_name']}, false)
          THEN 'source name length'
        WHEN length(source_uri) > {limit['source_uri']} THEN 'source uri length' END"""
    checked = rows.withColumn("held_because", F.expr(reason))
    return (
        checked.where("held_because IS NULL").drop("held_because"),
        checked.where("held_because IS NOT NULL"),
    )


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sha256", F.sha2("raw_content", 256))


def novel(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose content is not in ``known`` (a ``sha256`` column), each content once.

    The first observation id wins. Only ids and digests are compared; the texts
    themselves are not shuffled for it.
    """
    fresh = rows.select("observation_id", "sha256").join(
        known.select("sha256"), "sha256", "left_anti"
    )
    winners = fresh.groupBy("sha256").agg(F.min("observation_id").alias("observation_id"))
    return rows.join(winners.select("observation_id"), "observation_id", "left_semi")


def duplicates(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows that add nothing, with the observation that already holds their content."""
    both = earlier.selectExpr("sha256", "observation_id", "0 AS stage").unionByName(
        rows.selectExpr("sha256", "observation_id", "1 AS stage")
    )
    first = both.groupBy("sha256").agg(
        F.min(F.struct("stage", "observation_id")).alias("f")
    ).selectExpr("sha256", "f.observation_id AS prior_observation_id")
    return (
        rows.select("observation_id", "sha256")
        .join(first, "sha256")
        .where("observation_id <> prior_observation_id")
    )


def artifacts(rows: DataFrame) -> DataFrame:
    """One stored object per digest: size in bytes, place and type."""
    return rows.selectExpr(
        "sha256",
        "concat('art-', substr(sha256, 1, 32)) AS artifact_id",
        "coalesce(source_uri, concat('manual://', source_name)) AS storage_uri",
        "'text/plain' AS content_type",
        "CAST(octet_length(raw_content) AS BIGINT) AS size",
        "substr(sha256, 1, 2) AS digest_prefix",
    )


def content_store(rows: DataFrame) -> DataFrame:
    """Artifacts of a batch with each digest once (the first observation's place)."""
    firsts = rows.groupBy("sha256").agg(F.min("observation_id").alias("observation_id"))
    return artifacts(rows.join(firsts, ["sha256", "observation_id"], "left_semi"))


def evidence(rows: DataFrame) -> DataFrame:
    """Evidence rows extracted from observations, each bound to its artifact."""
    found = extract_identifiers(rows, "observation_id", "raw_content")
    origin = rows.selectExpr(
        "observation_id",
        "concat('art-', substr(sha256, 1, 32)) AS artifact_id",
        "coalesce(source_uri, concat('manual://', source_name)) AS source_uri",
    )
    return found.join(origin, "observation_id").selectExpr(
        "concat('ev-', substr(sha2(concat_ws('|', observation_id, kind, value), 256), 1, 32)) "
        "AS evidence_id",
        "artifact_id",
        "observation_id",
        "source_uri",
        "extraction_method",
        "value",
        "confidence",
        "dependence_group",
    )


def source_rows(firsts: DataFrame) -> DataFrame:
    """Registry rows of the first observation of each (source name, lawful basis)."""
    return firsts.selectExpr(
        "concat('src-', substr(sha2(concat_ws('|', source_name, lawful_basis), 256), 1, 32)) "
        "AS source_id",
        "source_name AS name",
        "source_type",
        "lawful_basis",
        "source_uri AS base_uri",
        "true AS is_active",
    )


def new_sources(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources to add: one per (name, lawful basis) not registered yet."""
    first = F.min(F.struct("observation_id", "source_type", "source_uri")).alias("f")
    firsts = rows.groupBy("source_name", "lawful_basis").agg(first)
    return (
        source_rows(firsts.select("source_name", "lawful_basis", "f.source_type", "f.source_uri"))
        .join(registry.select("name", "lawful_basis"), ["name", "lawful_basis"], "left_anti")
        .select("source_id", "name", "source_type", "lawful_basis", "base_uri", "is_active")
    )


def audit_entries(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One audit event per new observation, naming its digest and what was extracted.

    A source has 256 chains by the digest's first byte, so that no single walk holds all of
    a busy source's events.
    """
    counts = found.groupBy("observation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("extraction_method") == "regex:xmr_address").alias("x"),
    )
    return rows.join(counts, "observation_id", "left").selectExpr(
        "concat_ws('/', 'ingest', source_name, substr(sha256, 1, 2)) AS chain",
        "'ingest' AS actor_user_id",
        "'EVIDENCE_INGESTED' AS action",
        "'OBSERVATION' AS resource_type",
        "observation_id AS resource_id",
        "to_json(named_struct('extracted', coalesce(n, 0L), 'lawful_basis', lawful_basis, "
        "'sha256', sha256, 'source', source_name, 'xmr_abstain', coalesce(x, 0L) > 0)) AS payload",
    )


def ingest(raw: DataFrame, known_artifacts: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """The rows one batch of raw observations adds to each table."""
    accepted, held = gate(raw)
    rows = with_digest(accepted)
    fresh = novel(rows, known_artifacts)
    found = evidence(fresh)
    return {
        "held": held,
        "sources": new_sources(rows, registry),
        "artifacts": artifacts(fresh),
        "observations": fresh,
        "evidence": found,
        "audit_events": audit_entries(fresh, found),
    }
