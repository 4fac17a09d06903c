"""The sixteen named reads: name -> function of a ledger and parameters.

A ledger is a mapping of table names to frames. Reads about one entity take its id; the
wrapped operators accept frames of ids, so a batch of questions is one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators import audit, reads

Ledger = dict[str, DataFrame]


def _ids(ledger: Ledger, actor_id: str | None) -> DataFrame | None:
    if actor_id is None:
        return None
    return ledger["actors"].sparkSession.createDataFrame([(actor_id,)], "actor_id string")


def _profile(t: Ledger, actor_id: str) -> DataFrame:
    mine = {n: t[n].where(F.col("actor_id") == actor_id)
            for n in ("actors", "aliases", "pgp_keys", "wallets", "accounts")}
    sections = reads.profile_sections(
        mine["aliases"], mine["pgp_keys"], mine["wallets"], mine["accounts"]
    )
    return reads.actor_profiles(mine["actors"], sections)


def _links(t: Ledger, actor_id: str | None = None) -> DataFrame:
    rows = reads.actor_links(t["hypotheses"], t["actors"], _ids(t, actor_id))
    return rows.orderBy("actor_id", F.desc("calibrated_prob"), "hypothesis_id")


def _evidence(t: Ledger, actor_id: str | None = None, limit: int = 12) -> DataFrame:
    rows = reads.actor_evidence(
        t["hypotheses"], t["hypothesis_evidence"], t["evidence"], t["artifacts"],
        _ids(t, actor_id),
    )
    return reads.top_actor_evidence(rows, limit)


def _why(t: Ledger, hypothesis_id: str) -> DataFrame:
    items = t["hypothesis_evidence"].where(F.col("hypothesis_id") == hypothesis_id)
    totals = reads.family_totals(items)
    return items.join(totals, ["hypothesis_id", "family"], "left").select(
        "hypothesis_id", "evidence_id", "family", F.round("raw_llr", 4).alias("raw_llr"),
        F.round("contribution", 4).alias("contribution"), "is_contradiction",
        F.col("total").alias("family_total"),
    )


def _shared(t: Ledger, actor_id: str | None = None) -> DataFrame:
    ids = _ids(t, actor_id)
    handles = reads.shared_handle_owners(t["aliases"], t["actors"], ids).selectExpr(
        "'handle' AS kind", "handle_key AS value", "actor_count", "actor"
    )
    clusters = reads.shared_wallet_clusters(t["wallets"], ids)
    owners = reads.cluster_owners(t["wallets"], t["actors"]).join(
        clusters.select("cluster_id", "actor_count"), "cluster_id"
    )
    return handles.unionByName(
        owners.selectExpr("'wallet' AS kind", "cluster_id AS value", "actor_count", "actor")
    )


def _infrastructure(t: Ledger, limit: int = 10) -> DataFrame:
    services = reads.listing(t["services"], "service_id", limit)
    servers = reads.listing(t["servers"], "server_id", limit)
    shared = reads.shared_infrastructure(t["services"])
    return (
        shared.selectExpr("concat('shared_', kind) AS kind", "value", "service_count")
        .unionByName(services.selectExpr("'service' AS kind", "address AS value",
                                         "1L AS service_count"))
        .unionByName(servers.selectExpr("'server' AS kind", "ip_address AS value",
                                        "0L AS service_count"))
    )


def _stats(t: Ledger) -> DataFrame:
    names = ("actors", "aliases", "pgp_keys", "wallets", "services", "evidence", "artifacts",
             "observations", "sources", "hypotheses", "cases")
    return reads.ledger_stats(
        {n: t[n] for n in names if n in t}, t["hypotheses"], audit.verify(t["audit_log"])
    )


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "resolve_entity": lambda t, term: reads.resolve_entity(t["actors"], t["aliases"], term),
    "universal_search": lambda t, term, limit=8: reads.universal_search(t, term, limit),
    "list_actors": lambda t, limit=100: reads.roster(t["actors"], t["aliases"], limit),
    "get_actor_profile": _profile,
    "get_actor_links": _links,
    "get_actor_evidence": _evidence,
    "get_hypothesis_evidence": _why,
    "find_shared_identifiers": _shared,
    "get_evidence_provenance": lambda t, limit=10, kind=None: reads.evidence_provenance(
        t["evidence"], t["artifacts"], limit, kind
    ),
    "get_ledger_stats": _stats,
    "get_infrastructure": _infrastructure,
    "get_review_queue": lambda t, limit=10: reads.review_queue(
        t["hypotheses"], t["actors"], limit
    ),
    "get_cases": lambda t, limit=20: reads.latest(t["cases"], "created_at", "case_id", limit),
    "get_decisions": lambda t, limit=15: reads.decisions(
        t["reviews"], t["hypotheses"], t["actors"], limit
    ),
    "get_timeline": lambda t, limit=15: audit.timeline(t["audit_log"], limit),
    "get_sources": lambda t, limit=20: reads.listing(t["sources"], "source_id", limit),
}


def ask(ledger: Ledger, name: str, **params) -> DataFrame:
    """Run a named read."""
    return REGISTRY[name](ledger, **params)
