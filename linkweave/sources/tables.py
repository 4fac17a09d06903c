"""Ledger tables: declared schemas, scans, additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "users": "user_id string, email string, role string, created_at timestamp",
    "cases": "case_id string, title string, description string, status string, "
    "created_at timestamp",
    "case_members": "case_id string, user_id string, added_at timestamp",
    "case_identifiers": "identifier_id string, case_id string, id_type string, value string, "
    "created_at timestamp",
    "actors": "actor_id string, primary_alias string, category string, confidence double, "
    "last_seen timestamp, is_synthetic boolean",
    "aliases": "alias_id string, actor_id string, value string, platform string, source string, "
    "confidence double",
    "accounts": "account_id string, actor_id string, platform string, handle string",
    "pgp_keys": "key_row_id string, fingerprint string, key_id string, actor_id string, "
    "key_body string",
    "wallets": "wallet_id string, address string, chain string, cluster_id string, "
    "actor_id string",
    "services": "service_id string, address string, title string, favicon_hash int, "
    "tls_fingerprint string",
    "servers": "server_id string, ip_address string, asn string, provider string",
    "artifacts": "artifact_id string, sha256 string, storage_uri string, content_type string, "
    "size bigint, collected_at timestamp",
    "evidence": "evidence_id string, artifact_id string, source_uri string, "
    "collector_version string, extraction_method string, value string, confidence double, "
    "dependence_group string, created_at timestamp, retracted_at timestamp, "
    "retracted_by string, retraction_reason string",
    "hypotheses": "hypothesis_id string, subject_id string, object_id string, "
    "raw_log_lr double, calibrated_prob double, status string, model_version string, "
    "calibration_version string, created_at timestamp, reviewed_at timestamp, "
    "reviewer_id string",
    "hypothesis_evidence": "id string, hypothesis_id string, evidence_id string, family string, "
    "reliability_weight double, raw_llr double, contribution double, is_contradiction boolean",
    "reviews": "review_id string, hypothesis_id string, decision string, notes string, "
    "reviewer_id string, reviewed_at timestamp",
    "audit_log": "chain string, seq bigint, actor_user_id string, action string, "
    "resource_type string, resource_id string, payload string, payload_hash string, "
    "prev_hash string, entry_hash string, created_at timestamp",
    "sources": "source_id string, name string, source_type string, lawful_basis string, "
    "base_uri string, is_active boolean",
    "observations": "observation_id string, source_id string, raw_content string, "
    "content_hash string, observed_at timestamp, metadata_json string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one ledger table with its declared schema."""
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def register_views(spark: SparkSession, root: str) -> None:
    for name in SCHEMAS:
        read(spark, root, name).createOrReplaceTempView(name)


def append(df: DataFrame, root: str, name: str) -> None:
    conform(df, name).write.mode("append").parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns in order; missing ones are NULL, others are left out."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(name).fields
        ]
    )


def evolve(current: DataFrame, declared: T.StructType) -> DataFrame:
    """Add declared columns the table lacks, as NULL; never drop one it has."""
    have = set(current.columns)
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in declared.fields if f.name not in have
    ]
    return current.select("*", *missing)
